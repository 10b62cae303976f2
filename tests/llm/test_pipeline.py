from pyspark.sql import functions as F

import corpus_pipeline
from fleetlane.llm import toxicity
from fleetlane.llm.common import table
from fleetlane.llm.folds import held_out
from fleetlane.llm.queries import vocabulary

from . import brute, odd

SF = "/root/testdata/sf0.001"


def test_pipeline_is_that_of_plain_stages(spark):
    from tokenizers import Tokenizer

    lexicon = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"), ~held_out(F.col("doc_id")))
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    docs = {d: t for d, t in docs.items() if lexicon.score(*brute.toxicity_features(lexicon, t)[1:]) < 0.3}
    docs = {d: docs[d] for d, (_, c) in brute.near_duplicates(docs, 5, 80).items() if c == d}
    docs = {d: kept if gone else docs[d] for d, (_, gone, kept) in brute.cut_repeats(docs).items()}
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    index = {}
    for name, text in items:
        w = brute.ALNUM.findall(text.translate(brute.LOWER))
        n = min(13, len(w))
        for s in range(len(w) - n + 1):
            index.setdefault(tuple(w[s : s + n]), set()).add(name)
    clean = {}
    for d, text in docs.items():
        w = brute.ALNUM.findall((text or "").translate(brute.LOWER))
        hit = {j for n in {len(k) for k in index} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in index for j in range(i, i + n)}
        if not hit or 20 * len(hit) < len(w):
            clean[d] = text
    library = Tokenizer.from_file(vocabulary())
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(clean)
    for d, r in got.items():
        assert r["text"] == clean[d] == r["decoded"] and r["n_tokens"] == len(library.encode(clean[d], add_special_tokens=False).ids)


def test_stages_take_odd_documents(spark):
    docs = odd.frame(spark, odd.documents(7))
    columns = docs.columns
    for some in (docs, docs.limit(0), odd.clashing(docs)):
        columns = some.columns
        for name, stage in corpus_pipeline.STAGES:
            some = stage(spark, some, SF)
            assert name == "bpe" or some.columns == columns, name
        some.count()

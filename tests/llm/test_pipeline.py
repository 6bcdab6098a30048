"""The pipeline, stage by stage, against brute-force versions on its own input."""

import corpus_pipeline
from docgrid.llm import langid

from .corpus import documents, frame
from .test_dedup import brute_components, brute_lines
from .test_other import brute_hits, brute_mix


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages(spark, tmp_path):
    docs = documents(n=75)
    long = [t for _, t, *_ in docs if t and len(t.split()) > 60]
    items = [(i, " ".join(long[i].split()[5:25])) for i in range(3)]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, str(tmp_path))
        if name != "mix":
            assert after.columns == names
        after.write.parquet(f"{tmp_path}/{name}.parquet")
        out[name] = (rows_of(before), rows_of(spark.read.parquet(f"{tmp_path}/{name}.parquet")))
        before = spark.read.parquet(f"{tmp_path}/{name}.parquet")

    was, now = out["language"]
    assert now == [r for r in was if r[1] and langid.letters()[[ord(c) for c in r[1]]].any()]

    was, now = out["lines"]
    kept = {(d, t) for d, _, gone, t in brute_lines(was, 20) if not gone or t.strip(" ")}
    assert {(r[0], r[1]) for r in now} == kept and len(now) == len(kept) and all(r[4] == len(r[1]) for r in now)

    was, now = out["near_copies"]
    assert sorted(r[0] for r in now) == sorted(d for d, _, c in brute_components(was) if c == d)
    assert set(now) <= set(was) and len(now) < len(was)

    was, now = out["decontaminate"]
    hit = {x[0] for x in brute_hits(was, items) if x[-1]}
    assert hit and now == [r for r in was if r[0] not in hit]

    was, now = out["mix"]
    size, target = brute_mix(was)
    taken = dict.fromkeys(size, 0)
    for doc_id, source, n, total, aim, took in now:
        assert total == size[source] and abs(aim - target[source]) < 1e-6 and took <= 3 * n
        taken[source] += took
    assert len(now) == len(was) and all(abs(taken[s] - target[s]) <= 1 for s in size)

    assert rows_of(corpus_pipeline.run(spark, str(tmp_path))) == now


def test_empty_and_other_columns(spark, tmp_path):
    """No rows; and columns whose names an operator uses itself."""
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clash = "doc_id long, text string, lang string, source string, n_chars long, n_words long, _row string, _slot long, score double, contaminated boolean"
    one = spark.createDataFrame([(1, "the quick brown fox jumps over it", "en", "a", 33, 5, "r", 6, 0.5, True)], clash)
    for docs, n in ((frame(spark, []), 0), (one, 1)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, str(tmp_path))
            assert after.columns == docs.columns
            assert rows_of(after) == rows_of(docs) if n == 0 else after.count() == n


def test_near_copies_of_rows_that_share_an_id(spark, tmp_path):
    """Of rows without an id, or with one and the same, only the copies go."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, text(1)), (2, text(2)), (None, text(1) + " more"), (None, text(3)), (None, text(4)), (None, None), (5, text(2)), (5, text(6)), (8, text(7)), (8, text(7) + " more")]
    docs = frame(spark, [(d, t, None, None, 0) for d, t in rows])
    now = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, str(tmp_path)).collect()]
    gone = {(None, text(1) + " more"), (5, text(2))}
    assert len(now) == 7 and len({(8, text(7)), (8, text(7) + " more")} & set(now)) == 1
    assert {x for x in now if x[0] != 8} == {x for x in rows if x[0] != 8} - gone

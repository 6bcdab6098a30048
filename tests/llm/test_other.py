"""WARC, mixing, language, decontamination, personal data, chat and fingerprints."""

import hashlib
import json
import random
import re
import tracemalloc
import unicodedata

import duckdb
import numpy as np
import pytest

from docgrid.llm import chat, common, decontam, fingerprint, langid, mixing, pii, registry, warc

from .corpus import LOWER, documents, frame, words


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- 1 ------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    r = random.Random(1)
    big = "é<p>\r\n\r\n" * 40
    pages = [(i, f"http://x/{i}?q=a b\n%25é", r.choice([big, big + str(i % 3), "short", None, "", "x" * 99, "y" * 100])) for i in range(60)]
    pages += [(None, None, big), (61, None, big), (61, None, big)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    index = warc.write_warc(warc.mark_revisits(rows), str(tmp_path / "warc"), file_bytes=2000)
    first = {}
    for i, _, h in pages:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    many = [h for _, _, h in pages]
    want = []
    for i, _, h in pages:
        h = h or ""
        f = first.get(h) if many.count(h) > 1 else i
        revisit = len(h.encode()) >= 100 and f is not None and i != f
        want.append((i, len(h.encode()), sha(h), "revisit" if revisit else "response", f if revisit else None))
    got = warc.resolve_revisits(warc.read_warc(index, str(tmp_path / "warc")))
    assert sorted(map(str, want)) == sorted(str(tuple(x)) for x in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    # some records by their index rows only; payloads and urls come back
    some = warc.read_warc(index.where("page_id % 7 = 3 and record_type = 'response'"), str(tmp_path / "warc"), gap=10, span=500).collect()
    by_id = {p[0]: p for p in pages}
    assert some and all(x.payload.decode() == (by_id[x.page_id][2] or "") and x.url == by_id[x.page_id][1] for x in some)


def test_warc_empty(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    index = warc.write_warc(warc.mark_revisits(none), str(tmp_path / "warc"))
    assert warc.read_warc(index, str(tmp_path / "warc")).count() == 0


# -- 2 ------------------------------------------------------------------------------------------


def brute_mix(rows):
    size = {}
    for _, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, shut = sum(size.values()), set()
    while True:
        left = total - sum(3 * size[s] for s in shut)
        w = sum(weight[s] for s in order if s not in shut)
        over = {s for s in order if s not in shut and left * weight[s] >= 3 * size[s] * w}
        if not over:
            return size, {s: 3.0 * size[s] if s in shut else left * weight[s] / w for s in order}
        shut |= over


def test_mixing(spark):
    rows = documents(n=120) + [(i, "w " * 900, None, "zz", 1) for i in range(200, 204)] + [(None, "x y", None, "zz", 0)]
    got = mixing.mix_sources(frame(spark, rows)).collect()
    size, target = brute_mix(rows)
    taken = dict.fromkeys(size, 0)
    for x in got:
        assert x.source_size == size[x.source] and x.target == pytest.approx(target[x.source]) and x.taken <= 3 * x.size
        taken[x.source] += x.taken
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 1 for s in size)
    again = mixing.mix_sources(frame(spark, rows[::-1])).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    other = mixing.mix_sources(frame(spark, rows), seed="other").collect()
    assert sorted(map(str, got)) != sorted(map(str, other))
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    assert {x.taken for x in mixing.mix_sources(frame(spark, [(1, None, None, None, 0)])).collect()} == {0}


def test_mixing_feasible(spark):
    rows = [(f"s{i}", n, i % 3 + 1) for i, n in enumerate([0, 5, 10, 1000, 7, 3])]
    got = {r.source: r.target for r in mixing.water_fill(spark.createDataFrame(rows, "source string, source_size long, weight long")).collect()}
    assert sum(got.values()) == pytest.approx(1025) and all(got[s] <= 3 * n for s, n, _ in rows)


# -- 3 ------------------------------------------------------------------------------------------


def test_language(spark):
    r = random.Random(4)
    syllables = {"en": ["the", "ing", "th", "and", "er", "on"], "de": ["sch", "ung", "ein", "ü", "der", "ß"], "fr": ["eau", "é", "ç", "ent", "les", "è"]}
    text = lambda lang, n: " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))
    langs = [r.choice(["en", "de", "fr"]) for _ in range(300)]
    rows = [(i, text(x, r.randint(5, 80)), x if r.random() < 0.8 else None, "a", 0) for i, x in enumerate(langs)]
    names, table = model = langid.train(langid.learnable(frame(spark, rows)))
    assert names == ["de", "en", "fr"]
    assert table.sum(0) == pytest.approx(1, abs=1e-3)
    odd = [(400, None, None, None, 0), (401, "123 !!", "en", "", 0), (402, "", None, "", 0), (403, f"{text('en', 300)} {text('de', 100)}", None, "", 0), (None, text("fr", 9), "x", "", 0)]
    got = langid.predict(frame(spark, rows + odd).select("doc_id", "text"), model).collect()
    pred = {x.doc_id: (x.lang_pred, x.score) for x in got}
    assert np.mean([pred[i][0] == x for i, x in enumerate(langs)]) > 0.98
    assert pred[400] == pred[401] == pred[402] == ("und", 0.0) and pred[None][0] == "fr"
    assert pred[403][0] == "en" and 0.65 < pred[403][1] < 0.85
    assert all(0 <= s <= 1 for _, s in pred.values())
    nothing = langid.train(frame(spark, []))
    assert {x.lang_pred for x in langid.predict(frame(spark, rows[:5]).select("text"), nothing).collect()} == {"und"}


# -- 6 ------------------------------------------------------------------------------------------


def brute_hits(rows, items, n=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(LOWER))
    out = []
    for d, t, *_ in rows:
        w, hit, found = split(t), set(), set()
        for item, text in items:
            x = split(text)
            for i in range(max(1, len(x) - n + 1) if x else 0):
                k = x[i : i + n]
                for j in range(len(w) - len(k) + 1):
                    if w[j : j + len(k)] == k:
                        hit.update(range(j, j + len(k)))
                        found.add("" if item is None else str(item))
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_contamination(spark, block_bytes):
    r = random.Random(6)
    rows = documents(n=70)
    texts = [t for _, t, *_ in rows if t and len(t.split()) > 40]
    items = [(i, " ".join(r.choice(texts).split()[k : k + r.choice([3, 9, 10, 14, 25])])) for i in range(14) for k in [r.randint(0, 20)]]
    items += [(20, None), (21, "... ,,"), (None, "the the"), (22, " ".join(words(r, 15))), (3, items[5][1].upper()), (23, "an")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(frame(spark, rows), bench, block_bytes=block_bytes).drop("items")
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute_hits(rows, items)


def test_contamination_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontam.contamination(frame(spark, [(1, "a b", None, None, 0)]), none, carry=True).collect()
    assert [(x.n_words, x.n_hit, x._row.doc_id) for x in got] == [(2, 0, 1)]
    assert decontam.contamination(frame(spark, []), none).count() == 0


# -- 8 ------------------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    ok = {
        "email": lambda m: True,
        "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m: 16 <= len(d := re.sub("[ -]", "", m)) <= 19 and pii.luhn(d),
        "phone": lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    return [(k, *m.span()) for k, p in PLAIN.items() for m in re.finditer(p, text) if ok[k](m[0])]


def test_base_spans():
    r = random.Random(8)
    bits = ["a.b@c.de", "@", "x@y", "a@b@c.d", "1.2.3.4", "1.2.3.256", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+1 2", "é", "𝄞", " ", ".", "007.1.1.1", "+", "%a-@b-.c", "12", "-"]
    for _ in range(4000):
        text = "".join(r.choice(bits) for _ in range(r.randint(1, 8)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "@" * 100_000, "a@" * 100_000, "1." * 100_000, "+1" + " " * 200_000):
        pii.base_spans(text)


def test_field():
    field = pii.trained()
    right = wrong = missed = 0
    for text, gold in pii.sentences(200, 1234):
        found, want = set(pii.field_spans(text, field)), set(gold)
        right, wrong, missed = right + len(found & want), wrong + len(found - want), missed + len(want - found)
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.9


def test_pii_query(spark):
    rows = [(1, "mail bob.smith@mail.example.com or 10.0.0.1", None, None, 0), (2, None, None, None, 0), (3, "", None, None, 0), (4, "Version 2.0 of the license", None, None, 0), (None, 'the token = "9dd3c80004c73dc9e548fee51b23b527780d4f20" is', None, None, 0)]
    got = {x.doc_id: x for x in pii.find_pii(frame(spark, rows)).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].spans) == (1, 1, "email:5:31,ip:35:43")
    assert got[1].base_sha256 == sha(got[1].spans)
    assert got[2].spans == got[3].spans == got[4].spans == ""
    assert got[None].spans == "secret:13:53"


def test_pii_odd_texts(spark):
    """Thousands of leading zeros, spans of the field between base spans, no rows, columns with the operator's names."""
    field = pii.trained()
    zeros = "0" * 5000 + ".1.2.3 " + "0" * 5000 + "1.1.1.999"
    assert pii.base_spans(zeros) == [("ip", 0, 5006)]
    text = 'a@b.cd token = "9dd3c80004c73dc9e548fee51b23b527780d4f20" 10.0.0.1 '
    base, spans = pii.find_spans(text * 50, field)
    assert len(base) == 100 and sum(s[0] == "secret" for s in spans) == 50
    assert [s for s in spans if any(s not in base and s[1] < b and a < s[2] for _, a, b in base)] == []
    assert pii.find_pii(frame(spark, [])).count() == 0
    docs = frame(spark, [(7, text * 2000, None, None, 0)]).selectExpr("*", "1 as n_ip", "'x' as spans", "0 as n_added")
    got = pii.find_pii(docs).first()
    assert (got.n_email, got.n_ip, got.n_secret, got.n_added, got.n_spans) == (2000, 2000, 2000, 2000, 6000)


def test_field_memory_of_digits():
    """Segments are scored as they are reached: a long text of numbers holds no features of its whole."""
    r = random.Random(3)
    text = " ".join(str(r.randint(100, 999)) for _ in range(4000))
    pii.trained()
    tracemalloc.start()
    pii.find_spans(text, pii.trained())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12e6


# -- 9 ------------------------------------------------------------------------------------------


def test_chat_round_trip():
    r = random.Random(10)
    parts = ["\\", "<", "</turn>", '<turn role="user">', "\n", '"', "\\<", "é", "\\n", "### Assistant:", "", "q"]
    for _ in range(2000):
        turns = [(r.choice(["user", "assistant", 'a"<\\\nb', ""]), "".join(r.choice(parts) for _ in range(r.randint(0, 6)))) for _ in range(r.randint(0, 4))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for role, t in turns if role == "assistant"]


def test_chat_layouts(spark):
    records = [
        ({"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": None}]}, "messages", [("user", "u"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}], "id": "7"}, "share", [("user", "h"), ("assistant", "g")]),
        ({"instruction": "i", "input": "x", "output": "o"}, "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
        ({"instruction": "i", "input": "", "output": "o", "system": "s"}, "instruction", [("system", "s"), ("user", "i"), ("assistant", "o")]),
        ({"prompt": "p", "completion": "c"}, "completion", [("user", "p"), ("assistant", "c")]),
        ({"prompt": "p", "response": 3}, "response", [("user", "p"), ("assistant", "3")]),
        ({"question": "q", "answer": "a"}, "question", [("user", "q"), ("assistant", "a")]),
        ({"messages": []}, "messages", []),
        ({"text": "?"}, "unknown", []),
        ([1], "unknown", []),
    ]
    rows = [(i, json.dumps(x)) for i, (x, _, _) in enumerate(records)] + [(98, "{"), (99, None)]
    got = {x.k: x for x in chat.format_chat(spark.createDataFrame(rows, "k long, record string"), "k").collect()}
    for i, (_, layout, turns) in enumerate(records):
        assert (got[i].layout, chat.parse(got[i].formatted)) == (layout, turns)
    assert got[98].layout == got[99].layout == "unknown"


def test_chat_turns(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, None, None, "x"), (None, 0, "user", "n"), (1, 1, "assistant", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x.conv_id: x for x in chat.read_back(chat.format_chat(chat.records_of_turns(turns), "conv_id"), "conv_id").collect()}
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (3, sha("user\n\nassistant\na\nassistant\nb\n"), 2, sha("ab"))
    assert (got[2].loss_chars, got[None].n_turns) == (0, 1)


# -- 10 -----------------------------------------------------------------------------------------


def brute_canonical(text):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return re.sub("[\t-\r \x85   -     　]+", " ", folded).strip(" ")


ODD = ["", "A  b\n", "a b", " A B ", "Straße", "STRASSE", "ﬁn", "fin", "é", "é", "𝄞x", "İ", "i̇"]


@pytest.mark.parametrize("weak", [False, True])
def test_fingerprints(spark, monkeypatch, weak):
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprint, "ROWS_A_BLOCK", 7)
    texts = ODD + [t for _, t, *_ in documents(n=70)][:60]
    rows = [(3 * i, t, None, None, 0) for i, t in enumerate(texts)] + [(None, "last", None, None, 0)]
    digest = (lambda c: F.substring(F.md5(c), 1, 1)) if weak else fingerprint.bucket
    got = {x.doc_id: x for x in fingerprint.fingerprints(frame(spark, rows), digest).collect()}
    assert len(got) == len(rows)
    full = [t or "" for t in texts] + ["last"]
    ids = [3 * i for i in range(len(texts))] + [None]
    edited = [t[: len(t) - len(t) // 2] + full[(i + 1) % len(full)][: len(t) // 2] for i, t in enumerate(full)]
    prints = {}
    for i, d in enumerate(ids):
        x = got[d]
        assert (x.n_chars, x.edited_sha256) == (len(full[i]), sha(edited[i]))
        assert x.near_next == float(x.fingerprint == got[ids[(i + 1) % len(ids)]].fingerprint)
        assert x.near_edited == float(x.fingerprint == x.edited_fingerprint)
        for text, mark in ((full[i], x.fingerprint), (edited[i], x.edited_fingerprint)):
            prints.setdefault(brute_canonical(text), set()).add(mark)
    # one mark for each canonical text, and another one for every other
    assert all(len(v) == 1 for v in prints.values())
    assert len({m for v in prints.values() for m in v}) == len(prints)


def test_fingerprints_small(spark):
    assert fingerprint.fingerprints(frame(spark, [])).count() == 0
    one = fingerprint.fingerprints(frame(spark, [(5, "ab", None, None, 0)])).first()
    assert (one.edited_sha256, one.near_next) == (sha("aa"), 1.0)
    twice = fingerprint.fingerprints(frame(spark, [(5, "ab", None, None, 0)] * 2)).collect()
    assert len(twice) == 2 and {x.near_next for x in twice} == {1.0}


def test_fingerprint_blocks_of_far_ids(spark, monkeypatch):
    """One id far from all others, ids below zero, and many rows without an id: blocks stay small, and in order."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprint, "ROWS_A_BLOCK", 8)
    ids = [*range(300), 1 << 62, -(1 << 63), *[10**6 + i // 2 for i in range(100)]]
    rows = [(i, f"text {i}", None, None, 0) for i in ids] + [(None, f"{'abcdefgh'[i % 8]}{i}", None, None, 0) for i in range(200)]
    docs = frame(spark, rows).select(common.id_col().alias("_id"), "text")
    told = fingerprint.with_blocks(docs).groupBy("_block").agg(F.count("*").alias("n"), F.min(F.struct("_id", "text")).alias("low"), F.max(F.struct("_id", "text")).alias("high")).orderBy("_block").collect()
    assert sum(x.n for x in told) == len(rows) and max(x.n for x in told) <= 16
    assert all(a.high <= b.low for a, b in zip(told, told[1:]))
    got = {(x._id, x.text): x.next_text for x in fingerprint.successors(docs.withColumnRenamed("_id", "doc_id")).collect()}
    order = sorted((common.LAST_ID if d is None else d, t) for d, t, *_ in rows)
    assert got == {x: order[(k + 1) % len(order)][1] for k, x in enumerate(order)}


# -- all ----------------------------------------------------------------------------------------


def test_oracles_on_odd_rows(spark, tmp_path):
    """Queries with SQL, on tables with nulls, ties and empty texts."""
    docs = [*documents(n=75), (None, "q r s", None, None, 0)]
    turns = [(c, t, r, x) for c in (1, 2, -7, None) for t, r, x in ((0, "user", "a<b\\"), (1, "assistant", "é\n"), (1, "assistant", None), (None, None, ""))]
    pages = [(i, None, ["x" * 120, "y", None][i % 3]) for i in range(20)]
    tables = {
        "documents": frame(spark, docs),
        "conversations": spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"),
        "pages": spark.createDataFrame(pages, "page_id long, url string, html string"),
    }
    con = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("op1_warc", "op2_mixing", "op9_chat"):
        df = registry.queries()[name](spark, str(tmp_path))
        cols = sorted(df.columns)
        show = lambda rows: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
        got = show(df.select(*cols).collect())
        want = con.execute(f"select {', '.join(cols)} from ({registry.oracle_sql()[name]})").fetchall()
        assert got == show(want), name


def test_scratch_is_dropped(spark):
    with common.scope("mine"):
        df = common.materialize(spark.range(3), "x")
    assert df.count() == 3
    path = common._scratch["mine"][0][1]
    common.release("mine")
    import os

    assert not os.path.exists(path)

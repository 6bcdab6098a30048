"""Near copies, substrings and lines against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from docgrid.llm import line_dedup, ngram_join, substring_dedup
from docgrid.llm import common
from docgrid.llm.common import LAST_ID
from docgrid.llm.graph import components

from .corpus import LOWER, documents, frame, words

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = BLANK.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def reachable(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_components(rows):
    rows = sorted(rows)
    sets = [shingles(t) for _, t, *_ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = reachable(len(rows), links)
    return {(rows[i][0], len(sets[i]), rows[root[i]][0]) for i in range(len(rows))}


@pytest.mark.parametrize("few", [16, 2])
def test_near_duplicates(spark, monkeypatch, few):
    monkeypatch.setattr(ngram_join, "FEW", few)  # 2: nearly every shared key goes the way of the large ones
    rows = documents()
    found = {tuple(r) for r in ngram_join.near_duplicates(frame(spark, rows)).collect()}
    assert found == brute_components(rows)


def test_near_duplicates_chain_and_blocks(spark, monkeypatch):
    """A chain of edits: neighbours link, ends don't; compared in blocks of two."""
    r = random.Random(5)
    base, rows = words(r, 120), []
    for i in range(24):
        rows.append((100 - i, " ".join(base), "en", "a", 0))
        base = list(base)
        base[(7 * i) % 120] = f"edit{i}"
    rows += [(200 + i, " ".join(words(r, 40) + base[:60]), "en", "a", 0) for i in range(30)]
    monkeypatch.setattr(ngram_join, "FEW", 2)
    monkeypatch.setattr(ngram_join.with_sketches, "__defaults__", (2,))
    assert {tuple(x) for x in ngram_join.near_duplicates(frame(spark, rows)).collect()} == brute_components(rows)


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c d e f", None, None, 0), (None, None, None, None, 0), (1, "a b c d e f", "", "", 0), (1, "a b c d e f", "", "", 0), (2, "x", "", "", 0)]
    found = sorted(tuple(r) for r in ngram_join.near_duplicates(frame(spark, rows)).collect())
    assert found == [(1, 2, 1), (1, 2, 1), (2, 1, 2), (LAST_ID, 0, LAST_ID), (LAST_ID, 2, 1)]
    assert ngram_join.near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicates_of_rows_that_share_an_id(spark):
    """A row that is a copy takes neither its id's other rows nor their links away."""
    r = random.Random(8)
    three, nine, other = (" ".join(words(r, 80)) for _ in range(3))
    rows = [(3, three), (9, nine), (None, three), (None, nine + " X"), (7, other), (7, other + " X"), (5, three), (5, "alone")]
    rows += [(20, None), (20, "alone too"), (21, " "), (22, "alone it is")]
    rows = [(d, t, "", "", 0) for d, t in rows]
    found = sorted(tuple(x) for x in ngram_join.near_duplicates(frame(spark, rows)).collect())
    sets = [shingles(t) for _, t, *_ in rows]
    alike = lambda i, j: sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ids = [LAST_ID if d is None else d for d, *_ in rows]
    root = reachable(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if ids[i] == ids[j] or alike(i, j)])
    least = {x: min(d for d, y in zip(ids, root, strict=True) if y == x) for x in root}
    assert found == sorted((d, len(s), least[x]) for d, s, x in zip(ids, sets, root, strict=True))


def test_sketches():
    r = np.random.default_rng(3)
    for n in (40, 300, 2000):
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(n * 0.95)], r.integers(0, 1 << 63, int(n * 0.06), dtype=np.uint64)]))

        def sketch(x):
            bits = ngram_join.sketch_bits(len(x))
            return np.packbits((np.bincount((x >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) & 1).astype(np.uint8)).tobytes()

        far = len(np.setxor1d(a, b))
        assert ngram_join.distance(sketch(a), sketch(b)) <= far
        assert ngram_join.distance(sketch(a), sketch(a[:-1])) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7), (500, 501)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 200: 100, 150: 100, 500: 500, 501: 500}


def brute_windows(rows, window):
    first: dict = {}
    for d, t, *_ in rows:
        w = BLANK.findall(t or "")
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, LAST_ID + 1), LAST_ID if d is None else d)
    out = []
    for d, t, *_ in rows:
        w = BLANK.findall(t or "")
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (LAST_ID if d is None else d):
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((LAST_ID if d is None else d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("window", "prefix", "group"), [(50, 16, 20_000), (50, 16, 1), (12, 3, 3)])
def test_substrings(spark, window, prefix, group):
    rows = documents() + [(None, "the the " * 100, None, None, 0), (7, None, None, None, 0), (300, documents()[0][1], "", "", 0)]
    found, _ = substring_dedup.dedup_substrings(frame(spark, rows), window, prefix, group)
    assert sorted(tuple(r) for r in found.collect()) == brute_windows(rows, window)


def test_substrings_empty(spark):
    assert substring_dedup.dedup_substrings(frame(spark, []))[0].count() == 0


def test_every_window_has_an_anchor():
    words_, _ = common.word_hashes([" ".join(str(i * i % 37) for i in range(500)).encode()])
    at, _ = substring_dedup.anchors(words_, np.full(500, 500), 50, 16)
    assert all(((at >= i) & (at <= i + 34)).any() for i in range(451))


def test_word_hashes(monkeypatch):
    texts = ["a  b", None, "", " \t", "é\x85x y\n\x0bz a", "long" * 50 + " w" * 90, "b"]
    for stretch in (1 << 20, 7):
        monkeypatch.setattr(common, "STRETCH", stretch)
        got, sizes = common.word_hashes([t and t.encode() for t in texts])
        lists = [BLANK.findall(t or "") for t in texts]
        flat = [w for x in lists for w in x]
        assert sizes.tolist() == [len(x) for x in lists]
        assert len(set(zip(flat, got.tolist(), strict=True))) == len(set(flat)) == len(set(got.tolist()))


def edit_distance(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        row, last = [i], row
        for j, d in enumerate(y, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return row[-1]


def brute_lines(rows, least):
    places = sorted((LAST_ID if d is None else d, i, line.strip(" \t\n\r\x0b\x0c")) for d, t, *_ in rows if t is not None for i, line in enumerate(t.split("\n")))
    places = [p for p in places if p[2]]
    by_size = defaultdict(list)
    gone = set()
    for d, i, line in places:
        # an edit counts between lines of the least length; shorter ones must be equal
        if any(y == line or min(len(y), len(line)) >= least and edit_distance(line, y) <= 1 for n in (-1, 0, 1) for y in by_size[len(line) + n]):
            gone.add((d, i))
        by_size[len(line)].append(line)
    out = []
    for d, t, *_ in rows:
        lines = [] if t is None else t.split("\n")
        keep = [x for i, x in enumerate(lines) if (LAST_ID if d is None else d, i) not in gone]
        out.append((-1 if d is None else d, len(lines), len(lines) - len(keep), None if t is None else "\n".join(keep)))
    return sorted(out, key=str)


def test_lines(spark):
    r = random.Random(9)
    rows = []
    for i in range(60):
        lines = []
        for _ in range(r.randint(0, 6)):
            s = list("abcab" * r.randint(1, 2) + r.choice("abc") * r.randint(0, 2))
            for _ in range(r.randint(0, 2)):
                k = r.randrange(len(s))
                r.choice([lambda k=k, s=s: s.insert(k, r.choice("abcé𝄞")), lambda k=k, s=s: s.__setitem__(k, r.choice("abc")), lambda k=k, s=s: s.pop(k)])()
            lines.append(r.choice(["", " "]) + "".join(s) + r.choice(["", "\r"]))
        lines += r.sample(["{", "ab", "abc", "abca", "|", "", "\t"], r.randint(0, 2))
        rows.append((i, "\n".join(lines), "en", "a", 1))
    rows += [(60, None, None, None, None), (None, "abcababcab\nshort", None, None, 0), (61, "", "", "", 0)]
    got = line_dedup.dedup_lines(frame(spark, rows), min_chars=5).select("_row.doc_id", "n_lines", "n_removed", "_row.text").collect()
    found = sorted(((-1 if d is None else d, a, b, t) for d, a, b, t in got), key=str)
    assert found == brute_lines(rows, 5)
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_one_edit():
    r = random.Random(2)
    for _ in range(3000):
        x, y = ("".join(r.choice("ab") for _ in range(r.randint(1, 6))) for _ in range(2))
        assert line_dedup.within_one(x, y) == (edit_distance(x, y) <= 1)

r"""Personal data: base patterns, and a semi-Markov conditional random field for what they miss.

Base kinds (email, ip, card, phone) are exact patterns with checks; their spans always stay.  The field
scores whole spans - segments of up to ``MAX_TOKENS`` tokens - by features of the span as a whole
(shape, digit count, checksum, octet range, separators) and the words around it; dynamic programming
over bounded entity lengths chooses boundaries and types together.  It adds obfuscated addresses,
numbers in other notations and secrets (keys, tokens, passwords).  A span of the field that overlaps a
base span is dropped.

Segments need a digit, ``@`` or the word "dot" within, or a name such as password with its mark before them, so text
far from these is all outside and scores nothing: the chain falls apart exactly into islands around such tokens, and
cost follows their number.  Segments are scored as the decoder reaches them, so memory holds the features of one start
only.  The weights are learned here, by gradient steps on sentences generated from rules with a fixed seed.

Defined cases: null text is empty; very long texts are read whole, in linear time (possessive
patterns; addresses are found from their ``@``; spans are merged in order); numbers have any count of leading zeros;
rows repeat independently; columns beside doc_id and text are ignored, whatever their names; no rows give none.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
MAX_TOKENS = 16
Span = tuple[str, int, int]

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = max(at + 1, end)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, by kind and start."""
    found: list[Span] = [("email", *x) for x in emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p) < 4 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


# ---------------------------------------------------------------------------------------------
# the field

_TOKEN = re.compile(r"\w+|[^\w\s]")
_NAMES = ("password", "passwd", "secret", "token", "api_key", "key")
_TRIGGER = re.compile(r"[0-9@]|\bdot\b|\b(?:" + "|".join(_NAMES) + r")\s*[:=]")
_HOT = re.compile(r"[0-9@]|^dot$")
_DIGITS = re.compile(r"[0-9]+")
_OPENS = re.compile(r"[\w(+]")


def shape(text: str) -> str:
    out = []
    for c in text:
        s = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else " " if c.isspace() else c
        if not out or out[-1] != s:
            if len(out) == 12:
                break
            out.append(s)
    return "".join(out)


def features(text: str, a: int, b: int, before: str, after: str) -> list[str]:
    """Of the whole span text[a:b], and the tokens beside it."""
    span = text[a:b]
    groups = _DIGITS.findall(span)
    digits = "".join(groups)
    n, m = len(span), len(digits)
    out = [f"digits{min(m, 20)}", f"size{min(n // 4, 12)}", f"shape{shape(span)}", f"groups{'-'.join(str(len(g)) for g in groups[:6])}", f"before:{before.lower()}", f"after:{after.lower()}"]
    if "@" in span or "at" in span and re.search(r"\bat\b", span):
        out.append(f"at dots{span.count('.') + len(re.findall(r'\\bdot\\b', span))} {'@' in span}")
        out.append("at one" if len(re.findall(r"@|\bat\b", span)) == 1 else "at many")
        out.append("edges" if span[0].isalnum() and span[-1].isalpha() else "bad edges")
    if len(groups) == 4 and m and all(len(g) < 4 and int(g) < 256 for g in groups):
        out.append("octets" if re.fullmatch(r"[0-9]+(?:\W{1,3}[0-9]+){3}", span) else "octets?")
    if 13 <= m <= 19:
        out.append(f"luhn{luhn(digits)}")
    if m == n:
        out.append(f"only digits{min(m, 20)}")
    if " " not in span and n >= 12 and m and any(c.isalpha() for c in span) and span.isalnum():
        out.append(f"key hex{all(c in '0123456789abcdef' for c in span)} upper{span.isupper()} size{min(n // 8, 6)}")
        out.append("key")
    if span[0] == "+":
        out.append("plus")
    if span.count("(") != span.count(")"):
        out.append("unbalanced")
    if n != m and all(c in "+()0123456789.- /" for c in span):
        out.append(f"dialled{7 <= m <= 15}")
    return out


class Field:
    """Weights of a semi-Markov field with the states outside and inside an entity."""

    def __init__(self) -> None:
        self.w: dict[tuple[str, str], float] = defaultdict(float)
        self.join = {"stay": 0.0}  # two entities that touch
        self.table: dict[str, tuple[float, ...]] | None = None  # what rows() gives, once the weights are final

    def segments(self, text: str, tokens: list[tuple[int, int]]) -> Iterator[list[tuple[int, list[str]]]]:
        """For each start token in turn: (end token, features) of the segments that may be entities."""
        words = [text[a:b] for a, b in tokens]
        for i, (a, _) in enumerate(tokens):
            row: list[tuple[int, list[str]]] = []
            if _OPENS.match(words[i]):
                # the word before, beyond the marks that stand between a name and its value
                k = i - 1
                while k >= 0 and not words[k][0].isalnum() and i - k < 4:
                    k -= 1
                before = words[k] if k >= 0 else ""
                hot = k < i - 1 and words[k + 1] in ":=" and before.lower() in _NAMES
                for j in range(i, min(len(tokens), i + MAX_TOKENS)):
                    if j > i and tokens[j][0] - tokens[j - 1][1] > 2:
                        break
                    hot = hot or bool(_HOT.search(words[j]))
                    if hot and words[j][-1].isalnum():
                        row.append((j + 1, features(text, a, tokens[j][1], before, words[j + 1] if j + 1 < len(words) else "")))
            yield row

    def score(self, f: list[str], kind: str) -> float:
        w = self.w
        return w.get(("", kind), 0.0) + sum(w.get((x, kind), 0.0) for x in f)

    def rows(self) -> dict[str, tuple[float, ...]]:
        """Weights by feature, one a kind."""
        out: dict[str, list[float]] = {}
        for (name, kind), x in self.w.items():
            out.setdefault(name, [0.0] * len(KINDS))[KINDS.index(kind)] = x
        return {name: tuple(x) for name, x in out.items()}

    def decode(self, text: str, tokens: list[tuple[int, int]], weights: dict[str, tuple[float, ...]]) -> list[Span]:
        n, none = len(tokens), (0.0,) * len(KINDS)
        best = [[-math.inf, -math.inf] for _ in range(n + 1)]  # by state: 0 outside, 1 after an entity
        best[0][0] = 0.0
        back: list[list[tuple[int, int, str] | None]] = [[None, None] for _ in range(n + 1)]
        for i, row in enumerate(self.segments(text, tokens)):
            state = 0 if best[i][0] >= best[i][1] else 1
            if best[i][state] > best[i + 1][0]:
                best[i + 1][0], back[i + 1][0] = best[i][state], (i, state, "")
            enter = max((best[i][0], 0), (best[i][1] + self.join["stay"], 1))
            for j, f in row:
                told = [weights.get("", none), *(x for x in map(weights.get, f) if x)]
                most, kind = max(zip(map(sum, zip(*told, strict=True)), KINDS, strict=True), key=itemgetter(0))  # the first of equals
                s = enter[0] + most
                if s > best[j][1]:
                    best[j][1], back[j][1] = s, (i, enter[1], kind)
        spans, j, state = [], n, 0 if best[n][0] >= best[n][1] else 1
        while j > 0:
            i, before, kind = back[j][state]
            if kind:
                spans.append((kind, tokens[i][0], tokens[j - 1][1]))
            j, state = i, before
        return spans[::-1]

    def learn(self, text: str, gold: list[Span], rate: float) -> None:
        """A step up the conditional log-likelihood of one sentence (forward-backward over segments)."""
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        n, lattice = len(tokens), list(self.segments(text, tokens))
        alpha, beta = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
        alpha[0] = beta[n] = 0.0

        def plus(x: float, y: float) -> float:
            hi, lo = (x, y) if x > y else (y, x)
            return hi if lo == -math.inf else hi + math.log1p(math.exp(lo - hi))

        scores = [[[self.score(f, k) for k in KINDS] for _, f in row] for row in lattice]
        for i in range(n):
            alpha[i + 1] = plus(alpha[i + 1], alpha[i])
            for (j, _), s in zip(lattice[i], scores[i], strict=True):
                for x in s:
                    alpha[j] = plus(alpha[j], alpha[i] + x)
        for i in range(n - 1, -1, -1):
            beta[i] = beta[i + 1]
            for (j, _), s in zip(lattice[i], scores[i], strict=True):
                for x in s:
                    beta[i] = plus(beta[i], beta[j] + x)
        true = {(a, b): k for k, a, b in gold}
        for i in range(n):
            for (j, f), s in zip(lattice[i], scores[i], strict=True):
                kind_true = true.get((tokens[i][0], tokens[j - 1][1]))
                for kind, x in zip(KINDS, s, strict=True):
                    step = rate * ((kind == kind_true) - math.exp(min(0.0, alpha[i] + x + beta[j] - alpha[n])))
                    if abs(step) > 1e-4:
                        for name in ("", *f):
                            self.w[name, kind] += step


def sentences(n: int, seed: int) -> Iterator[tuple[str, list[Span]]]:
    """Labelled sentences by rule: entities in several notations, and numbers that are none."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["an", "er", "the", "on", "ti", "es", "be", "lo", "qu", "sch"]) for _ in range(r.randint(1, 4)))

    def card() -> str:
        body = r.choice("3456") + num(14)
        number = body + next(c for c in "0123456789" if luhn(body + c))
        return r.choice([number, f"{number[:4]}.{number[4:8]}.{number[8:12]}.{number[12:]}", " ".join(number[i : i + 4] for i in range(0, 16, 4)), "/".join(number[i : i + 4] for i in range(0, 16, 4))])

    def unchecked() -> str:
        number = card()
        return number[:-1] + str((int(number[-1]) + r.randint(1, 9)) % 10)

    def email() -> str:
        user, host, top = r.choice([word(), f"{word()}.{num(2)}", f"{word()}_{word()}"]), word() + r.choice(["", num(1)]), r.choice(["com", "org", "net", "de"])
        return r.choice([f"{user}@{host}.example.{top}", f"{user}@{host}.{top}", f"{user}@{host}.{top}", f"{user} @ {host}.{top}", f"{user}@{host} dot {top}", f"{user} at {host} dot {top}"])

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{num(2)} {a} {b}{c}", f"{a}.{b}.{c}", f"00{num(2)} {a} {b}{c}"])

    def secret() -> str:
        alphabet = r.choice(["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijABCDEFGHIJ0123456789"])
        body = "".join(r.choice(alphabet) for _ in range(r.choice([14, 16, 18, 30, 38]))) + num(2)
        return "AKIA" + body[-16:].upper() if r.random() < 0.2 else body

    make = {"email": email, "ip": lambda: ".".join(str(r.randint(1, 254)) for _ in range(4)), "card": card, "phone": phone, "secret": secret}
    none = [
        lambda: f"Version {r.randint(1, 9)}.{r.randint(0, 9)}", lambda: f"version {r.randint(1, 9)}", lambda: f"CC BY-NC {r.randint(1, 4)}.0",
        lambda: str(r.randint(1900, 2030)), lambda: num(r.randint(1, 6)), lambda: f"{num(2)}.{num(2)}.{r.randint(1990, 2030)}", lambda: f"{r.randint(1990, 2030)}-0{r.randint(1, 9)}-{num(2)}",
        lambda: f"{r.randint(1, 99)}.{num(2)} EUR", lambda: f"{num(1)},{num(3)},{num(3)}", lambda: f"{word()}{num(2)}", lambda: f"page {num(3)}", lambda: f"{r.randint(1, 23)}:{num(2)}",
        lambda: f"ISBN {num(3)}-{num(1)}-{num(4)}", lambda: f"@ {word()}", lambda: f"{num(4)} {num(4)}", lambda: num(r.randint(9, 13)), lambda: f"{num(3)} {num(3)} {num(3)}", lambda: f"a{num(3)}.{num(1)}",
        unchecked, unchecked, lambda: f"the dot {word()}", lambda: f"{word()} at {word()}", lambda: f"at {word()} the dot", lambda: f"key: {word()}",
    ]
    names = {"secret": ["password=", 'token = "', "key: ", "secret=", "", "api_key="], "phone": ["call ", "", "tel: "], "email": ["mail ", ""], "card": ["card ", ""], "ip": ["host ", "", "On "]}
    for _ in range(n):
        text, gold = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(1, 3))) + r.choice([" ", " ", ". ", ", "])
            if r.random() < 0.6:
                kind = r.choice(KINDS)
                text += r.choice(names[kind])
                value = make[kind]()
                gold.append((kind, len(text), len(text) + len(value)))
                text += value + r.choice(['" ', " "] if 'token = "' in text[-70:] else [" ", ". ", ", "])
            else:
                text += r.choice(none)() + r.choice([" ", ". "])
        yield text + word(), gold


@cache
def trained(n: int = 600, epochs: int = 5, seed: int = 7) -> Field:
    field, rows = Field(), list(sentences(n, seed))
    for epoch in range(epochs):
        for text, gold in rows:
            field.learn(text, gold, 0.3 / (1 + epoch))
    field.w = {k: v for k, v in field.w.items() if abs(v) > 0.01}
    field.table = field.rows()
    return field


def islands(text: str, reach: int = 100) -> Iterator[tuple[int, int]]:
    """Stretches of text around triggers, wide enough for every segment that holds one."""
    low = high = -1
    for m in _TRIGGER.finditer(text):
        if high >= 0 and m.start() - high <= 2 * reach:
            high = m.end()
            continue
        if high >= 0:
            yield low, high
        low, high = m.start(), m.end()
    if high >= 0:
        yield low, high


def field_spans(text: str, field: Field, reach: int = 100) -> list[Span]:
    out, weights = [], field.rows() if field.table is None else field.table
    for low, high in islands(text, reach):
        # whole tokens on both sides
        a, b = max(0, low - reach), min(len(text), high + reach)
        while a > 0 and (text[a - 1].isalnum() or text[a - 1] == "_"):
            a -= 1
        while b < len(text) and (text[b].isalnum() or text[b] == "_"):
            b += 1
        tokens = [(x + a, y + a) for x, y in (m.span() for m in _TOKEN.finditer(text[a:b]))]
        out += field.decode(text, tokens, weights)
    return out


def find_spans(text: str | None, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: by kind as listed, then start."""
    if not text or not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    taken, extra, k = sorted((a, b) for _, a, b in base), [], 0
    ends = list(accumulate((b for _, b in taken), max))
    for s in field_spans(text, field):  # in order, so one pass over both
        while k < len(taken) and taken[k][0] < s[2]:
            k += 1
        if not k or ends[k - 1] <= s[1]:
            extra.append(s)
    rank = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + extra, key=lambda s: (rank[s[0]], s[1], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (all), n_secret and
    n_added (of the field: secrets, and all its spans), n_spans (all)."""
    weights = dict((field or trained()).w)
    stay = (field or trained()).join["stay"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field()
        own.w, own.join = weights, {"stay": stay}
        own.table = own.rows()
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base, spans = find_spans(text, own)
                count = [sum(s[0] == k for s in base) for k in BASE]
                out.append((*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), sum(s[0] == "secret" for s in spans), len(spans) - len(base), len(spans)))
            cols = list(zip(*out, strict=True)) or [()] * 9
            kinds = (pa.int64(),) * 4 + (pa.string(), pa.string()) + (pa.int64(),) * 3
            names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_secret", "n_added", "n_spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_added long, n_spans long")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``; null texts have none."""
    return find_pii(read(spark, sf_dir, "documents"))


QUERIES = {"op8_pii": op8_pii}
#: A trained model beside exact patterns: base spans are tested against the plain patterns, the field by held-out sentences.
ORACLE: dict[str, str] = {}

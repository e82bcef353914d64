"""Personal data: candidate spans, boosted trees, calibrated thresholds.

Fixed base patterns (mail addresses, IPv4 addresses, card and phone numbers) always count.  Beside
them generators of high recall propose overlapping spans of further shapes; gradient boosted trees
over format and context features score these, and a threshold for each kind, calibrated to a wanted
precision on held-out simulated cases, selects what is redacted.

No labels of personal data exist, so the trees learn from simulated texts: true items in many shapes
and look-alikes (versions, dates, prices, counters, hashes), from a fixed seed.

Defined results: null and empty texts have no spans; offsets are code points, end exclusive; base
spans win over added ones that overlap them; of overlapping added spans the one with the higher score,
then the earlier, then the longer stays.  Repeated rows give equal results, extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, texts

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret")
ORDER = {k: i for i, k in enumerate(KINDS)}

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LONG_NUMBER = re.compile(r"[0-9][\x20-]?(?:[0-9][\x20-]?){12}[0-9]")

AT = re.compile(r" ?[\[({<][aA][tT][\])}>] ?| [aA][tT] ")
SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| ?[\[({<]dot[\])}>] ?| dot )[A-Za-z0-9-]+)+", re.I)
DIGIT = re.compile("[0-9]")
#: A call prefix of two digits, and a number.
PHONE_DIGITS = 17
SECRET_WORDS = ("token", "secret", "passw", "key")
SECRET_MARKS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "sk_")

#: Generators of further candidates that hold a digit: kind and pattern.
NUMBERS = (
    ("phone", re.compile(r"(?<![\w.+-])\(?[0-9]{2,4}\)?[ ./-]{1,2}[0-9]{3,4}[ ./-][0-9]{3,5}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.+-])00[0-9][0-9 ()./-]+[0-9](?!\w)")),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)")),
)
ASSIGNED = re.compile(r"(?<!\w)(?:api[_-]?key|secret|token|passw(?:or)?d|access[_-]?key)[\"']?[ \t]*[:=]\s*[\"']?[A-Za-z0-9_/+.=-]{8,}", re.I)
MARKED = re.compile(r"(?<!\w)(?:AKIA[0-9A-Z]{16}(?!\w)|gh[pousr]_[A-Za-z0-9_]{20,}|sk[-_][A-Za-z0-9_-]{16,})")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of LOCAL+@DOMAIN, found from the @ signs: linear in any text."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the base patterns, by start and then kind."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    if LONG_NUMBER.search(text):
        for m in CARD.finditer(text):
            d = digits_of(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping proposals of the generators."""
    out = []
    for m in AT.finditer(text):
        start = m.start()
        while start and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start() and (domain := SPELLED_DOMAIN.match(text, m.end())):
            out.append(("email", start, domain.end()))
    if DIGIT.search(text):
        out += [(kind, m.start(), m.end()) for kind, pattern in NUMBERS for m in pattern.finditer(text) if kind != "phone" or len(digits_of(m[0])) <= PHONE_DIGITS]
    low = text.lower()
    if any(w in low for w in SECRET_WORDS):
        out += [("secret", m.start(), m.end()) for m in ASSIGNED.finditer(text)]
    if any(w in text for w in SECRET_MARKS):
        out += [("secret", m.start(), m.end()) for m in MARKED.finditer(text)]
    return out


# Words beside a span that speak for an item of the kind.
CONTEXT = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "account", "bank"),
    "secret": ("key", "token", "password", "secret"),
}
AGAINST = ("version", "release", "page", "order", "invoice", "part", "isbn", "line", "total", "step", "commit", "checksum")


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def span_features(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format and context of a span."""
    s, before, after = text[a:b], text[max(0, a - 40) : a].lower(), text[b : b + 20].lower()
    d = digits_of(s)
    value = re.split(r"[:=]", s, maxsplit=1)[-1].strip(" \"'") if kind == "secret" else s
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
    return [
        float(ORDER[kind]),
        float(len(s)),
        float(len(d)),
        len(d) / max(1, len(s)),
        float(len(set(value))) / max(1, len(value)),
        float(classes),
        float(sum(w in before for w in CONTEXT[kind])),
        float(sum(w in before or w in after for w in AGAINST)),
        float(iban_ok(s)) if kind == "iban" else -1.0,
        float(luhn(d)) if len(d) >= 13 else -1.0,
        float(int(d[:3]) not in (0, 666) and int(d[:3]) < 900 and d[3:5] != "00" and d[5:] != "0000") if kind == "ssn" and len(d) == 9 else -1.0,
        float("(" in s or "[" in s or "{" in s or "<" in s),
        float(len(set(re.sub(r"[0-9A-Za-z]", "", s)))),
        float(before[-1:] in "$#€£") if before else 0.0,
        float("." in s and not re.search("[a-zA-Z]", s)),
        float(bool(re.search(r"(?:com|org|net|edu|io|de|fr|es|uk)$", s, re.I))),
        float(bool(re.search(r" at | dot ", s, re.I))),
    ]


def simulated(n: int, seed: int) -> list[tuple[str, str, int, int, int]]:
    """Texts with one true item or look-alike each: text, kind, start, end, label."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(k))

    def iban(valid: bool) -> str:
        body, land = digits(18), r.choice(("DE", "FR", "ES", "GB", "NL"))
        check = 98 - int(body + "".join(str(int(c, 36)) for c in land) + "00") % 97
        check = check if valid else (check + r.randint(1, 90)) % 97
        s = f"{land}{check:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if r.random() < 0.4 else s

    def ssn(valid: bool) -> str:
        return f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}" if valid else f"{r.choice(('000', '666', '9' + digits(2)))}-{digits(2)}-{digits(4)}"

    true = (
        ("email", lambda: f"{word()}.{word()}{r.choice((' [at] ', ' (at) ', '[at]', '(at)', ' at '))}{word()}{r.choice((' [dot] ', ' (dot) ', '[dot]', ' dot '))}{r.choice(('com', 'org', 'net', 'de'))}"),
        ("phone", lambda: r.choice((f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"0049 {digits(3)} {digits(7)}"))),
        ("ssn", lambda: ssn(True)),
        ("iban", lambda: iban(True)),
        ("secret", lambda: f"{r.choice(('api_key', 'token', 'secret', 'password', 'access_key'))}{r.choice((' = ', '=', ': '))}{r.choice(('', chr(34)))}{r.choice((hexa(32), hexa(40), mixed(20), mixed(32)))}"),
        ("secret", lambda: r.choice(("AKIA" + mixed(16).upper(), "ghp_" + mixed(36), "sk-" + mixed(32)))),
    )
    false = (
        ("email", lambda: f"{word()} at {word()}{r.choice(('.', ' dot '))}{word()}"),
        ("email", lambda: f"{word()} at {word()}.{r.randint(1, 99)}"),
        ("phone", lambda: r.choice((f"{r.randint(10, 31)}/{digits(4)}/{digits(4)}", f"{digits(4)} {digits(4)} {digits(4)}", f"{digits(3)} {digits(4)} {digits(3)}", f"{digits(4)}/{digits(3)}/{digits(5)}"))),
        ("ssn", lambda: ssn(False)),
        ("iban", lambda: iban(False)),
        ("secret", lambda: f"{r.choice(('token', 'password', 'secret', 'key'))}{r.choice((': ', ' = '))}{word()}{word()}{word()}"),
    )
    good, bad = ("contact", "call", "phone", "mail", "account", "iban", "ssn", "card", "reach", "bank"), (*AGAINST, "about", "near")
    out = []
    while len(out) < n:
        label = int(r.random() < 0.5)
        kind, make = r.choice(true if label else false)
        lead = " ".join([word() for _ in range(r.randint(1, 5))] + ([r.choice(good if label else bad)] if r.random() < 0.4 else []) + [word()] * (r.random() < 0.3))
        text = f"{lead} {make()} {word()} {word()}."
        out += [(text, k, a, b, label) for k, a, b in candidates(text) if k == kind][:1]
    return out


@dataclass(frozen=True)
class BoostedTrees:
    """feature, cut: nodes of full trees of equal depth in heap order; leaf: their values."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    prior: float
    rate: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            z += self.rate * v[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-z))


def boost(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> BoostedTrees:
    """Gradient boosting of logistic loss with Newton leaves; cuts are the features' quantiles."""
    prior = float(np.log(max(1e-6, y.mean()) / max(1e-6, 1 - y.mean())))
    z, cuts = np.full(len(y), prior), [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 24)[1:-1])) for j in range(x.shape[1])]
    features, values, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        f, c = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for k in range(2**depth - 1):
            own = node == k
            if own.sum() >= 8:
                best, gs, hs = 1e-9, g[own].sum(), h[own].sum()
                for j, edges in enumerate(cuts):
                    for e in edges:
                        right = own & (x[:, j] > e)
                        gr, hr = g[right].sum(), h[right].sum()
                        gain = gr**2 / (hr + ridge) + (gs - gr) ** 2 / (hs - hr + ridge) - gs**2 / (hs + ridge)
                        if gain > best:
                            best, f[k], c[k] = gain, j, e
            node[own] = 2 * k + 1 + (x[own, f[k]] > c[k])
        v = np.array([g[m].sum() / (h[m].sum() + ridge) for m in (node == k + 2**depth - 1 for k in range(2**depth))])
        z += rate * v[node - (2**depth - 1)]
        features.append(f)
        values.append(c)
        leaves.append(v)
    return BoostedTrees(np.array(features), np.array(values), np.array(leaves), prior, rate, depth)


@dataclass(frozen=True)
class PiiModel:
    trees: BoostedTrees
    thresholds: dict[str, float]


@lru_cache(maxsize=4)
def fit_pii_model(*, cases: int = 1600, precision: float = 0.98, seed: int = 7) -> PiiModel:
    """Trees from one set of simulated cases; for each kind the least threshold that keeps ``precision``
    on another set.  A process fits each model once."""
    train, held = simulated(cases, seed), simulated(cases, seed + 1)
    matrix = lambda rows: np.array([span_features(*r[:4]) for r in rows])
    trees = boost(matrix(train), np.array([r[4] for r in train], np.float64))
    scores, thresholds = trees.score(matrix(held)), {}
    for kind in KINDS:
        own = sorted(((s, r[4]) for s, r in zip(scores, held, strict=True) if r[1] == kind), reverse=True)
        right, limit = 0, 1.1
        for i, (s, label) in enumerate(own, 1):
            right += label
            if right >= precision * i and s >= 0.5:
                limit = float(s)
        thresholds[kind] = limit
    return PiiModel(trees, thresholds)


class Intervals:
    """Intervals that don't overlap, in order; those that it starts with are merged where they do."""

    def __init__(self, first: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(first):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def add(self, a: int, b: int) -> bool:
        """Takes the interval if it overlaps none."""
        at = bisect.bisect_right(self.ends, a)  # the first that ends after a
        if at < len(self.starts) and self.starts[at] < b:
            return False
        self.starts.insert(at, a)
        self.ends.insert(at, b)
        return True


def find_spans(text: str, model: PiiModel) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and base and added spans together, each by start and then kind."""
    base = base_spans(text)
    found = candidates(text)
    if not found:
        return base, base
    taken = Intervals([(a, b) for _, a, b in base])
    scores = model.trees.score(np.array([span_features(text, *c) for c in found]))
    picked = sorted((-round(float(s), 9), a, -b, k) for s, (k, a, b) in zip(scores, found, strict=True) if s >= model.thresholds[k])
    added: list[tuple[str, int, int]] = []
    for _, a, nb, kind in picked:
        if taken.add(a, -nb):
            added.append((kind, a, -nb))
    return base, sorted([*base, *added], key=lambda s: (s[1], ORDER[s[0]]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans go as one, under
    the kind of the first."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def detect_pii(docs: DataFrame, model: PiiModel, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), redact: bool = False) -> DataFrame:
    """Per row: the ``keep`` columns, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, and with
    ``redact`` also ``redacted`` (null for a null text)."""
    small_batches(docs.sparkSession)
    cols = list(keep)
    kept = docs.select(*cols, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.drop("_text").dtypes) + ", n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string" + ", redacted string" * redact
    names = [*cols, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", *["redacted"] * redact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[], [], [], []]
            sha, spans, clean = [], [], []
            for x in b.column("_text"):
                text = x.as_py()
                base, every = find_spans(text or "", model)
                for kind, column in zip(KINDS, counts, strict=False):
                    column.append(sum(s[0] == kind for s in base))
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
                if redact:
                    clean.append(None if text is None else redacted(text, every))
            arrays = [*(b.column(i) for i in range(len(cols))), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(clean, pa.string())] * redact, names)

    return kept.mapInArrow(run, schema)


def redact_pii(docs: DataFrame, model: PiiModel, *, text_col: str = "text") -> DataFrame:
    """The rows with the spans of their texts replaced; a null text stays null."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = [None if (text := x.as_py()) is None else redacted(text, find_spans(text, model)[1]) for x in b.column(text_col)]
            at = b.schema.get_field_index(text_col)
            yield b.set_column(at, b.schema.field(at), pa.array(clean, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


#: Counts of the base spans, by the patterns as they are given.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS mails, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ips,
  list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS cards, list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phones FROM d),
c AS (SELECT doc_id, mails, phones, list_filter(ips, lambda x: len(list_filter(string_split(x, '.'), lambda p: len(ltrim(p, '0')) > 3 OR CAST('0' || right(ltrim(p, '0'), 3) AS INTEGER) > 255)) = 0) AS ips,
  list_filter(cards, lambda x: len(x) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(x[len(x) + 1 - i] AS INTEGER) WHEN CAST(x[len(x) + 1 - i] AS INTEGER) > 4 THEN 2 * CAST(x[len(x) + 1 - i] AS INTEGER) - 9 ELSE 2 * CAST(x[len(x) + 1 - i] AS INTEGER) END)) % 10 = 0) AS cards FROM m)
SELECT doc_id, CAST(len(mails) AS BIGINT) AS n_email, CAST(len(ips) AS BIGINT) AS n_ip, CAST(len(cards) AS BIGINT) AS n_card, CAST(len(list_filter(phones, lambda x: len(x) BETWEEN 10 AND 15)) AS BIGINT) AS n_phone FROM c"""

"""Personal data: candidate spans, boosted trees over format and context, calibrated selection.

Base rules find emails, addresses, card and phone numbers that are certain; they always count.
Beside them, high-recall generators propose overlapping candidate spans. Gradient-boosted trees
score each candidate from its format and context; a threshold per kind, calibrated on candidates
the trees did not see, selects further spans. Labels come from the base rules: a candidate that
covers exactly a base span is positive, and so is one that covers a base phone or email rewritten
into a form the rules don't know (no '+', other separators, [at] and [dot]); the thresholds are
calibrated on forms the trees did not see. Candidates of such forms that the texts hold themselves
have no label, any other is negative. The number checks and marks of the rules (Luhn, part ranges,
'+', '@') are no features, so the trees judge by form and surroundings alone.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewright.session import batch_rows, cut, drop_path, shared_path

KINDS = ("email", "ip", "card", "phone")
BATCH_ROWS = 1000
PRECISION = 0.98  #: calibrated precision that a kind's threshold must reach
MASKS = {k: f"[{k.upper()}]" for k in KINDS}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, int]  #: start, kind's place in KINDS, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping emails, found from each at-sign outwards."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = free = m.end()
            yield start, end
        at = text.find("@", end)


def base_spans(text: str) -> list[Span]:
    """The certain spans, by start and then kind; offsets are code points."""
    out: list[Span] = [(s, 0, e) for s, e in _emails(text)]
    if re.search("[0-9]", text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


#: High-recall generators: (kind, pattern). Spans of different generators may overlap.
_GENERATORS = (
    (0, re.compile(r"[^\s@<>,;:\"()\[\]]{1,64}@[^\s@<>,;:\"()\[\]]{1,255}")),
    (0, re.compile(r"[^\s()\[\]]{1,64} ?[(\[]at[)\]] ?[^\s()\[\]]{1,64}(?: ?[(\[]dot[)\]] ?[^\s()\[\]]{1,63}){1,8}", re.I)),
    (1, re.compile(r"(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){2,7}(?![0-9])")),
    (2, re.compile(r"(?<![0-9])[0-9](?:[ ./-]?[0-9]){10,20}(?![0-9])")),
    (3, re.compile(r"(?<![0-9])(?:\+|00)?[0-9(](?:[ ().-]{0,2}[0-9]){6,16}(?![0-9])")),
)
_CONTEXT = re.compile(
    r"(?P<w0>e-?mail|mail|contact|courriel|correo)|(?P<w1>\bip\b|host|addr|server|from)"
    r"|(?P<w2>card|visa|credit|karte|carte|tarjeta)|(?P<w3>phone|tel|call|fax|mobil)", re.I)  # fmt: skip
N_FEATURES = 20


def candidates(text: str) -> list[tuple[Span, list[float]]]:
    """Candidate spans of all generators with their features; a span appears once for a kind."""
    if not re.search(r"[0-9@]|[(\[]at[)\]]", text):
        return []
    found: dict[Span, list[float]] = {}
    for kind, pattern in _GENERATORS:
        for m in pattern.finditer(text):
            start, end = m.span()
            while end > start and text[end - 1] in ".,;:!?%&$*#":
                end -= 1
            if end > start and (start, kind, end) not in found:
                found[start, kind, end] = _features(text, start, kind, end)
    return sorted(found.items())


def _features(text: str, start: int, kind: int, end: int) -> list[float]:
    s = text[start:end]
    n = len(s)
    left, right = text[start - 1 : start], text[end : end + 1]
    near = {m.lastgroup for m in _CONTEXT.finditer(text[max(0, start - 40) : start])}
    digits = len(_digits(s))
    groups = re.findall(r"[0-9]+", s)
    return [
        *(float(kind == k) for k in range(4)),
        float(n), float(digits), digits / n, float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(s.count(".")), float(s.count("-")), float(s.count(" ")), float(s.count("(")),
        float(sum(c.isalpha() for c in s)), float(not left or left.isspace()), float(not right or right.isspace()), float(left.isalnum() or right.isalnum()),
        float(f"w{kind}" in near), float(bool(near)),
    ]


_NATIONAL = re.compile(r"(?:[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]{0,2}[0-9]{3}[ .-][0-9]{4}")


def _unlabelled(kind: int, s: str) -> bool:
    """Whether a candidate has a form in which the rules don't find personal data."""
    return kind == 0 and "@" not in s or kind == 3 and bool(_NATIONAL.fullmatch(s))


def _rewritten(kind: int, s: str, half: int, form: int) -> str:
    """A base email or phone in one of three forms a half that the rules don't know; the halves share none."""
    if kind == 0:
        a, b = "()" if half else "[]"
        gap = "" if form == 1 else " "
        name, domain = s.split("@", 1)
        parts = domain.rsplit(".", 1) if form == 2 else domain.split(".")
        return f"{name}{gap}{a}at{b}{gap}" + f"{gap}{a}dot{b}{gap}".join(parts)
    groups = re.findall("[0-9]+", s)
    national = groups[1:] if len(_digits("".join(groups[1:]))) >= 7 else groups
    if half:
        return (".".join(national), " ".join(national), "-".join(groups))[form]
    if form == 2:
        return "-".join(national)
    return s[1:] if form == 0 or national is groups else s[1:].removeprefix(groups[0]).lstrip(" .-)")


def _dated(s: str, half: int, form: int) -> str:
    """A date or a list of small numbers made from a phone's digits: what must not pass for a phone."""
    k = int(_digits(s)[-6:])
    year, month, day, hour = 1950 + k % 90, f"{1 + k % 12:02}", f"{1 + k % 28:02}", f"{k % 24:02}"
    if form == 3:
        return f"{day}-{month}-{year} {hour}" if half else f"{year}-{month}-{day} {hour}:{day}"
    return f"{day}.{month}.{year} {hour}-{day}" if half else f"{k % 800}-{k % 800 + 9} ({year}) {day}-{hour}"


class _Cover:
    """Stretches of a text as sorted pieces that don't overlap, so that asking for an overlap is a binary search."""

    def __init__(self, stretches: Iterable[tuple[int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(stretches):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        k = bisect_right(self.ends, start)
        return k < len(self.starts) and self.starts[k] < end

    def add(self, start: int, end: int) -> None:
        """A stretch that meets none of the others."""
        k = bisect_right(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)


def _planted(text: str, base: list[Span], half: int) -> Iterator[tuple[int, float, list[float]]]:
    """(kind, label, features) of candidates on rewritten emails and phones of ``text``: positive if they cover one exactly.

    Forms 3 and 4 put dates and numbers in the place of phones, whose candidates are all negative.
    """
    for form in range(5):
        parts, at, shift, planted = [], 0, 0, set()
        for start, kind, end in base:
            if (kind == 3 or kind == 0 and form < 3) and start >= at:
                new = _rewritten(kind, text[start:end], half, form) if form < 3 else _dated(text[start:end], half, form)
                parts += [text[at:start], new]
                planted.add((start + shift, kind, start + shift + len(new)))
                at, shift = end, shift + len(new) - (end - start)
        if planted:
            near = _Cover((a, b) for a, _, b in planted)
            for s, f in candidates("".join([*parts, text[at:]])):
                if s in planted or near.meets(s[0], s[2]):
                    yield s[1], float(form < 3 and s in planted), f


class SpanModel:
    """Boosted trees as flat arrays, and for each kind the probability that selects a span."""

    def __init__(self, trees: list[tuple], weights: list[float], thresholds: list[float]):
        self.trees, self.weights, self.thresholds = trees, weights, thresholds

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for (feature, cut_at, left, right, value), w in zip(self.trees, self.weights, strict=True):
            at = np.zeros(len(x), np.int64)
            while (inner := np.flatnonzero(feature[at] >= 0)).size:
                node = at[inner]
                at[inner] = np.where(x[inner, feature[node]] <= cut_at[node], left[node], right[node])
            total += w * value[at]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-2 * self.margins(x)))

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Selected candidates that overlap no base span and no better candidate."""
        if not self.trees or not (found := candidates(text)):
            return []
        kept = _Cover((a, b) for a, _, b in base)
        found = [(s, f) for s, f in found if not kept.meets(s[0], s[2])]
        if not found:
            return []
        p = self.scores(np.array([f for _, f in found]))
        taken: list[Span] = []
        used = _Cover()
        for k in sorted(range(len(found)), key=lambda k: (-p[k], found[k][0])):
            s = found[k][0]
            if p[k] >= self.thresholds[s[1]] and not used.meets(s[0], s[2]):
                taken.append(s)
                used.add(s[0], s[2])
        return taken


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SpanModel:
    """Train on the candidates of all documents.

    A hash of the id deals them into halves: one fits the trees, the other, with other rewritten forms, calibrates the thresholds:
    scores are binned, precision is made monotone over the bins, and a kind's threshold is the first bin that reaches
    ``PRECISION``. A kind without such a bin adds nothing; without both classes there is no model.
    Null and empty texts hold nothing to learn from; a very long one gives as many candidates as it
    holds; equal candidates of one half weigh as one row; null and repeated ids, other columns and
    their names make no difference; an empty table gives a model that adds nothing.
    """
    spark = docs.sparkSession
    batch_rows(spark, BATCH_ROWS)
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["id"], pdf["text"]):
                if text:
                    base = set(base_spans(text))
                    half = int(hashlib.md5(str(doc).encode()).hexdigest(), 16) % 2
                    out += [(half, s[1], float(s in base), f) for s, f in candidates(text) if s in base or not _unlabelled(s[1], text[s[0] : s[2]])]
                    out += [(half, *c) for c in _planted(text, sorted(base), half)]
            yield pd.DataFrame(out, columns=["half", "kind", "label", "x"])

    # one row per distinct form keeps frequent forms from filling the table
    found = texts.mapInPandas(run, "half int, kind int, label double, x array<double>")
    table = cut(found.groupBy("half", "kind", "label", "x").agg(F.count("*").cast("double").alias("weight")), "pii-forms")
    seen = {(r["half"], r["label"]): r["n"] for r in table.groupBy("half", "label").agg(F.count("*").alias("n")).collect()}
    if not {(0, 0.0), (0, 1.0)} <= seen.keys():
        return SpanModel([], [], [2.0] * 4)
    table = table.withColumn("features", array_to_vector("x"))
    forms = seen[0, 0.0] + seen[0, 1.0]
    train = table.where("half = 0").coalesce(2 + forms // 50_000)
    bins = max(32, math.isqrt(forms) + 1)  # Spark looks for split points in a sample of max(10,000, bins ** 2) rows
    gbt = GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.3, seed=7, maxBins=bins, weightCol="weight", cacheNodeIds=False).fit(train)
    path = shared_path(spark, "pii-trees")
    gbt.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()  # at most 12 trees of 31 nodes
    drop_path(spark, path)
    trees = []
    for k in range(gbt.getNumTrees):
        own = {r["id"]: r for r in nodes if r["treeID"] == k}
        feature, cut_at, left, right, value = (np.zeros(len(own), t) for t in (np.int64, float, np.int64, np.int64, float))
        for i, r in own.items():
            leaf = r["leftChild"] < 0
            feature[i] = -1 if leaf else r["split"]["featureIndex"]
            cut_at[i] = 0 if leaf else r["split"]["leftCategoriesOrThreshold"][0]
            left[i], right[i], value[i] = r["leftChild"], r["rightChild"], r["prediction"]
        trees.append((feature, cut_at, left, right, value))
    model = SpanModel(trees, list(gbt.treeWeights), [2.0] * 4)
    scored = gbt.transform(table.where("half = 1")).select("kind", "label", "weight", F.floor(vector_to_array("probability")[1] * 50).cast("int").alias("bin"))
    binned = scored.groupBy("kind", "bin").agg(F.sum("weight").alias("n"), F.sum(F.col("label") * F.col("weight")).alias("good")).collect()  # 4 kinds x 51 bins
    for kind in range(len(KINDS)):
        model.thresholds[kind] = _threshold([(r["bin"], r["n"], r["good"]) for r in binned if r["kind"] == kind])
    return model


def _threshold(bins: list[tuple[int, float, float]]) -> float:
    blocks: list[list[float]] = []  # first bin, rows, positives; pooled until precision rises
    for b, n, good in sorted(bins):
        blocks.append([b, n, good])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            _, n, good = blocks.pop()
            blocks[-1][1] += n
            blocks[-1][2] += good
    return next((b / 50 for b, n, good in blocks if good >= PRECISION * n), 2.0)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def detect(docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base, spans) per row; counts are of base spans.

    ``base`` and ``spans`` list kind:start:end by start and then kind. Null and empty texts have no
    spans; null ids, repeated rows and clashing other columns are passed over or kept as they are;
    an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                base = base_spans(text) if text else []
                counts = [sum(k == kind for _, k, _ in base) for kind in range(4)]
                out.append((*counts, _joined(base), _joined(sorted(base + model.added(text or "", base)))))
            got = pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "spans"])
            yield pd.concat([pdf[["id"]].reset_index(drop=True), got], axis=1)

    batch_rows(docs.sparkSession, BATCH_ROWS)
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(
        run, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string"
    )
    return found.withColumnRenamed("id", id_col)


def redact_text(text: str | None, model: SpanModel) -> str | None:
    """``text`` with each span replaced by its kind's mask; of overlapping spans the first masks."""
    if not text:
        return text
    base = base_spans(text)
    out, at = [], 0
    for start, kind, end in sorted(base + model.added(text, base)):
        if start >= at:
            out += [text[at:start], MASKS[KINDS[kind]]]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: SpanModel, text_col: str = "text") -> DataFrame:
    """``docs`` with masked texts.

    Null and empty texts stay, repeated rows stay repeated, and all other columns come back as they
    are, whatever their names; an empty table stays empty.
    """
    batch_rows(docs.sparkSession, BATCH_ROWS)

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact_text(t, model))

    return docs.withColumn(text_col, mask(F.col(text_col)))

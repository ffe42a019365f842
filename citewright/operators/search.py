"""Word search: the whole query grammar, evaluated on rows or on a stored table of postings.

The grammar is that of SQLite's full-text search (FTS5), from the strongest binding to the weakest:

    "a phrase"  word  pre*  a + b      tokens next to each other; ^ in front: only at a column's start
    NEAR(a "b c", 5)                   phrases of one column, at most 5 (10) tokens between the first and the last
    title : x   {title authors} : x   - title : (x OR y)      only in, or not in, these columns
    a b   then   a NOT b   then   a AND b   then   a OR b     brackets as usual

Tokens are runs of letters and digits, without case and accents. A query is parsed on the driver into a
tree; a tree becomes one boolean column over the places of its tokens. ``matches`` takes the places from
the texts of a row, ``SearchIndex`` from postings (term, column, id, places), so that a search reads the
terms it asks for and never a text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import and_, or_

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}\p{Co}]+"
_WORDS = regex.compile(TOKEN)
_LEXEME = regex.compile(r'\s+|(?P<string>"(?:[^"]|"")*")|(?P<mark>[(){}:,+*^-])|(?P<bare>[\w\x1a\x80-\U0010FFFF]+)|(?P<bad>.)', regex.DOTALL)


class _Fold(dict):
    """Code point to its lower case without accents; marks that stand alone go."""

    def __missing__(self, code: int) -> str:
        char = chr(code).lower()
        parts = unicodedata.normalize("NFD", char)
        if len(parts) > 1 and all(unicodedata.category(c) == "Mn" for c in parts[1:]):
            char = parts[0]
        self[code] = "" if unicodedata.category(char[0]) == "Mn" else char
        return self[code]


_FOLD = _Fold()


def tokens(text: str | None) -> list[str]:
    """The tokens of a text, as the index has them."""
    return _WORDS.findall((text or "").translate(_FOLD))


@lru_cache(1)
def _accents() -> tuple[str, str]:
    """Letters that fold to another single letter than their lower case, and those letters."""
    found = [(chr(c), _FOLD[c]) for c in (*range(0xC0, 0x600), *range(0x1E00, 0x2000)) if len(_FOLD[c]) == 1 and _FOLD[c] != chr(c)]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def token_list(text: Column) -> Column:
    """The tokens of a text as an array; null has none. Letters outside Latin, Greek, Cyrillic and their
    neighbours keep their accents here, which is what tells it from ``tokens``."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), *_accents())
    return F.regexp_extract_all(F.regexp_replace(plain, r"\p{Mn}+", ""), F.lit(TOKEN), F.lit(0))


@dataclass(frozen=True)
class Token:
    text: str
    prefix: bool = False


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def _any_between(places: Column, low: Column, high: Column) -> Column:
    return F.exists(places, lambda p: (p >= low) & (p <= high))


@dataclass(frozen=True)
class Near:
    """Phrases that stand within ``gap`` tokens in one of ``columns`` (one phrase: anywhere in it)."""

    phrases: tuple[tuple[Token, ...], ...]
    columns: tuple[str, ...]
    gap: int = 10
    first: bool = False

    def tokens(self) -> Iterator[Token]:
        for phrase in self.phrases:
            yield from phrase

    def holds(self, places: Callable[[Token, str], Column]) -> Column:
        if not self.phrases or not self.columns:
            return F.lit(False)
        return reduce(or_, (self._in(lambda t, c=c: places(t, c)) for c in self.columns))

    def _in(self, places: Callable[[Token], Column]) -> Column:
        starts = []
        for phrase in self.phrases:
            at = places(phrase[0])
            for k, token in enumerate(phrase[1:], 1):
                at = F.array_intersect(at, _moved(places(token), k))
            starts.append(at)
        if self.first:
            return F.array_contains(starts[0], 0)
        if len(starts) == 1:
            return F.size(starts[0]) > 0
        # The phrase that starts last decides: every other one ends at most ``gap`` tokens before it.
        sizes = [len(p) for p in self.phrases]

        def close(all_starts: Column) -> Column:
            lists = [all_starts[f"s{k}"] for k in range(len(sizes))]
            inside = lambda last: reduce(and_, (_any_between(at, last - n - self.gap, last) for at, n in zip(lists, sizes, strict=True)))
            return F.exists(reduce(F.array_union, lists), inside)

        # A list of one struct, so that the starts are worked out once and not for each candidate.
        return F.exists(F.array(F.struct(*(at.alias(f"s{k}") for k, at in enumerate(starts)))), close)


@dataclass(frozen=True)
class Both:
    """left ``how`` right, where how is AND, OR or NOT."""

    how: str
    left: Near | Both
    right: Near | Both

    def tokens(self) -> Iterator[Token]:
        yield from self.left.tokens()
        yield from self.right.tokens()

    def holds(self, places: Callable[[Token, str], Column]) -> Column:
        a, b = self.left.holds(places), self.right.holds(places)
        return a & b if self.how == "AND" else a | b if self.how == "OR" else a & ~b


Node = Near | Both


class _Parser:
    """Precedence climbing over lexemes; what the grammar doesn't know is an error, never a guess."""

    BINDS = {"OR": 1, "AND": 2, "NOT": 3}

    def __init__(self, query: str, columns: tuple[str, ...]):
        self.query, self.columns, self.at = query, columns, 0
        self.lexemes: list[tuple[str, str]] = []
        for found in _LEXEME.finditer(query):
            kind, text = found.lastgroup, found.group()
            if kind == "bad":
                raise ValueError(f"{text!r} can't stand in the query {query!r}")
            if kind == "bare" and text in self.BINDS:
                kind = "operator"
            if kind:
                self.lexemes.append((kind, text))

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.lexemes[self.at + ahead] if self.at + ahead < len(self.lexemes) else ("end", "")

    def take(self, kind: str, text: str | None = None) -> str:
        found = self.peek()
        if found[0] != kind or text not in (None, found[1]):
            raise ValueError(f"{found[1] or 'its end'!r} isn't expected in the query {self.query!r}")
        self.at += 1
        return found[1]

    def is_mark(self, text: str, ahead: int = 0) -> bool:
        return self.peek(ahead) == ("mark", text)

    def whole(self) -> Node:
        node = self.expression(1, self.columns)
        self.take("end")
        return node

    def expression(self, least: int, columns: tuple[str, ...]) -> Node:
        node = self.operand(columns)
        while self.peek()[0] == "operator" and self.BINDS[self.peek()[1]] >= least:
            how = self.take("operator")
            node = Both(how, node, self.expression(self.BINDS[how] + 1, columns))
        return node

    def operand(self, columns: tuple[str, ...]) -> Node:
        within = self.column_list(columns)
        if self.is_mark("("):
            self.take("mark", "(")
            node = self.expression(1, columns if within is None else within)
            self.take("mark", ")")
            return node
        parts = [self.near(columns if within is None else within)]
        while self.peek()[0] in ("string", "bare") or self.peek()[1] in ("^", "{", "-"):
            within = self.column_list(columns)
            parts.append(self.near(columns if within is None else within))
        # Beside others a phrase without a token asks for nothing; alone it is found nowhere.
        asked = [p for p in parts if p.phrases] or parts[:1]
        return reduce(lambda a, b: Both("AND", a, b), asked)

    def column_list(self, columns: tuple[str, ...]) -> tuple[str, ...] | None:
        """The columns that a list before a colon leaves of ``columns``; None without a list."""
        start, without = self.at, self.is_mark("-")
        if without:
            self.take("mark", "-")
        if self.is_mark("{"):
            self.take("mark", "{")
            names = []
            while not self.is_mark("}"):
                names.append(self.string())
            self.take("mark", "}")
        elif self.peek()[0] in ("string", "bare") and self.is_mark(":", 1):
            names = [self.string()]
        elif without:
            raise ValueError(f"no columns after '-' in the query {self.query!r}")
        else:
            self.at = start
            return None
        self.take("mark", ":")
        known = {c.lower(): c for c in self.columns}
        for name in names:
            if name.lower() not in known:
                raise ValueError(f"no column {name!r} in the query {self.query!r}")
        named = {known[n.lower()] for n in names}
        return tuple(c for c in columns if (c in named) != without)

    def string(self) -> str:
        kind, text = self.peek()
        if kind not in ("string", "bare"):
            raise ValueError(f"{text or 'its end'!r} isn't expected in the query {self.query!r}")
        self.at += 1
        return text[1:-1].replace('""', '"') if kind == "string" else text

    def near(self, columns: tuple[str, ...]) -> Near:
        if self.peek() == ("bare", "NEAR") and self.is_mark("(", 1):
            self.at += 2
            phrases, gap = [], 10
            while not (self.is_mark(")") or self.is_mark(",")):
                phrases.append(self.phrase())
            if self.is_mark(","):
                self.take("mark", ",")
                number = self.string()
                if not number.isdecimal():
                    raise ValueError(f"{number!r} isn't a number in the query {self.query!r}")
                gap = int(number)
            self.take("mark", ")")
            return Near(tuple(p for p in phrases if p), columns, gap)
        first = self.is_mark("^")
        if first:
            self.take("mark", "^")
        phrase = self.phrase()
        return Near((phrase,) if phrase else (), columns, first=first)

    def phrase(self) -> tuple[Token, ...]:
        out: list[Token] = []
        while True:
            found = [Token(t) for t in tokens(self.string())]
            if self.is_mark("*"):
                self.take("mark", "*")
                found[-1:] = [Token(t.text, True) for t in found[-1:]]
            out += found
            if not self.is_mark("+"):
                return tuple(out)
            self.take("mark", "+")


def parse(query: str, columns: tuple[str, ...]) -> Node:
    """The tree of a query; ValueError where it isn't in the grammar.

    A query without quotes, asterisk or AND, OR, NOT between blanks is plain: each of its words, whatever
    it holds, asks for words that start with it. A blank query finds nothing.
    """
    query = query.strip()
    if not query:
        return Near((), columns)
    if not any(mark in query for mark in ('"', "*", " AND ", " OR ", " NOT ")):
        query = " ".join(f'"{word}"*' for word in query.split())
    return _Parser(query, columns).whole()


def matches(query: str, *texts: Column, **named: Column) -> Column:
    """Whether a row's texts hold what ``query`` asks for; it may name those given by name. Null texts hold nothing."""
    named = {f"text{k}": text for k, text in enumerate(texts)} | named
    lists = {name: token_list(text) for name, text in named.items()}

    def places(token: Token, column: str) -> Column:
        fits = (lambda w: w.startswith(token.text)) if token.prefix else (lambda w: w == token.text)
        return F.filter(F.transform(lists[column], lambda w, k: F.when(fits(w), k)), lambda k: k.isNotNull())

    def holds(node: Node) -> Column:
        """Single words need no places."""
        if isinstance(node, Both):
            a, b = holds(node.left), holds(node.right)
            return a & b if node.how == "AND" else a | b if node.how == "OR" else a & ~b
        if len(node.phrases) == 1 and len(node.phrases[0]) == 1 and not node.first and node.columns:
            (token,) = node.phrases[0]
            fits = (lambda w: w.startswith(token.text)) if token.prefix else (lambda w: w == token.text)
            return reduce(or_, (F.exists(lists[c], fits) for c in node.columns))
        return node.holds(places)

    return holds(parse(query, tuple(named)))


class SearchIndex:
    """Postings of some text columns in a folder, written in batches.

    postings/batch=N has (term, column, id, places) sorted by term, gone/batch=N the ids whose earlier
    postings batch N replaces, and batches/N says that both are whole. A batch that failed halfway has no
    such mark: readers don't see it, and the next one overwrites it. The id column must be a whole number.
    """

    def __init__(self, spark: SparkSession, path: str, columns: tuple[str, ...]):
        self.spark, self.path, self.columns = spark, path.rstrip("/"), tuple(columns)

    def _batches(self) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batches")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(int(f.getPath().getName()) for f in files.listStatus(root)) if files.exists(root) else []

    def _commit(self, batch: int) -> None:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batches/{batch}")
        mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(mark, False).close()  # fails if another writer was first

    def add(self, rows: DataFrame, id_col: str = "id", removed: DataFrame | None = None) -> None:
        """Index ``rows``, in place of what the index had for their ids; forget the ids of ``removed``.

        Null texts have no postings; rows without an id are left out. Ids should be unique: repeated rows
        change nothing, different texts under one id lie over each other, place by place.
        """
        batch = (self._batches() or [-1])[-1] + 1
        columns = self.columns
        kept = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), *(F.col(c).cast("string").alias(f"t{k}") for k, c in enumerate(columns)))
        gone = kept.select("id")
        if removed is not None:
            gone = gone.union(removed.select(F.col(id_col).cast("long")))
        gone.where("id is not null").distinct().write.mode("overwrite").parquet(f"{self.path}/gone/batch={batch}")

        def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                terms, where, ids, places = [], [], [], []
                for k, column in enumerate(columns):
                    for i, text in zip(part.column("id").to_pylist(), part.column(f"t{k}"), strict=True):
                        at: dict[str, list[int]] = {}
                        for p, token in enumerate(tokens(text.as_py())):
                            at.setdefault(token, []).append(p)
                        terms += at
                        places += at.values()
                        where += [column] * len(at)
                        ids += [i] * len(at)
                arrays = [pa.array(terms, pa.string()), pa.array(where, pa.string()), pa.array(ids, pa.int64()), pa.array(places, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, ["term", "column", "id", "places"])

        found = kept.mapInArrow(postings, "term string, column string, id long, places array<int>")
        # By term and id, so that a frequent term goes to as many files as it needs.
        found.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{self.path}/postings/batch={batch}")
        self._commit(batch)

    def postings(self, wanted: Column) -> DataFrame:
        """The postings in force among those that ``wanted``, a condition on term, picks."""
        batches = self._batches()
        kind = "term string, column string, id long, places array<int>"
        if not batches:
            return self.spark.createDataFrame([], kind)
        found = self.spark.read.schema(f"{kind}, batch int").option("basePath", f"{self.path}/postings").parquet(*[f"{self.path}/postings/batch={b}" for b in batches]).where(wanted)
        if len(batches) > 1:
            gone = self.spark.read.schema("id long, batch int").option("basePath", f"{self.path}/gone").parquet(*[f"{self.path}/gone/batch={b}" for b in batches[1:]])
            last = gone.groupBy(F.col("id").alias("of")).agg(F.max("batch").alias("until"))
            found = found.join(last, (F.col("id") == F.col("of")) & (F.col("batch") < F.col("until")), "left_anti")
        return found.select("term", "column", "id", "places")

    def search(self, query: str) -> DataFrame:
        """(id) of the rows that hold what ``query`` asks for.

        One scan reads the postings of its terms, pruned by the sorted files, and one shuffle by id brings a
        row's places together.
        """
        node = parse(query, self.columns)
        asked = list(dict.fromkeys(node.tokens()))
        if not asked:
            return self.spark.createDataFrame([], "id long")
        fits = {t: F.col("term").startswith(t.text) if t.prefix else F.col("term") == t.text for t in asked}
        found = self.postings(reduce(or_, fits.values()))
        names = {(t, c): f"p{k}" for k, (t, c) in enumerate((t, c) for t in asked for c in self.columns)}
        gather = [F.flatten(F.collect_list(F.when(fits[t] & (F.col("column") == c), F.col("places")))).alias(n) for (t, c), n in names.items()]
        return found.groupBy("id").agg(*gather).where(node.holds(lambda t, c: F.col(names[t, c]))).select("id")

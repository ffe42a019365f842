"""Removal of authors' names: a ledger of names and tokens, replacement everywhere, and undoing it.

Names count as equal by ``normal_name``. A ledger has token, name and variants, a JSON list of other
forms of the name. Lists and single names are replaced by joins on normal names; free texts are searched
for the names of all entries in one pass, or one for each ``PASS`` of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewright.functions.names import unused
from citewright.operators.panes import ranked
from citewright.operators.phrases import Phrase, replace_in_texts
from citewright.session import cut

# Fixed: how stored tokens begin and look, and what readers see instead.
PREFIX = "Redacted Author "
TOKEN = f"^{PREFIX}[0-9a-f]{{6,}}$"
SHOWN = "Name Redacted by Author Request"


def is_token(value: Column) -> Column:
    return F.coalesce(F.trim(value).rlike(TOKEN), F.lit(False))


_BLANK = r"[\s\x1c-\x1f]"  # with (?U): all white space of Unicode, no-break spaces too


def bare(text: Column) -> Column:
    """No white space of any kind at the ends."""
    return F.regexp_replace(text, f"(?U)^{_BLANK}+|{_BLANK}+$", "")


@lru_cache(1)
def _folds() -> dict[str, str]:
    """Lower-case letters that caseless comparison takes for others, sharp s as ss among them."""
    every = (chr(c) for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000)
    return {c: c.casefold() for c in every if c.casefold() != c == c.lower()}


def casefolded(text: Column) -> Column:
    """Lower case for comparison; only texts that hold a special letter are taken apart."""
    folds, low = _folds(), F.lower(text)
    table = F.create_map(*(F.lit(x) for pair in folds.items() for x in pair))
    special = low.rlike("[" + "".join(folds) + "]")
    return F.when(special, F.array_join(F.transform(F.split(low, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")).otherwise(low)


def normal_name(name: Column) -> Column:
    """Without case, with single spaces, no blanks or .,; at the ends."""
    return casefolded(F.trim(F.regexp_replace(name, f"(?U){_BLANK}+", " "), F.lit(" .,;")))


def name_hash(name: Column, salt: str) -> Column:
    return F.sha2(F.concat(normal_name(name), F.lit(f"|{salt}")), 256)


def shown(authors: Column) -> Column:
    """A ;-list for readers: tokens as the phrase that stands for them."""
    parts = F.filter(F.transform(F.split(authors, ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.when(is_token(x), SHOWN).otherwise(x)), "; ")


def mint(names: DataFrame, ledger: DataFrame, salt: str) -> DataFrame:
    """(name, token) for new names: the shortest of 6, 8, .. 32 digits of their hash that no one has.

    Of new names with equal digits the first by name takes them. The whole hash stands where all are taken.
    """
    new = names.select("name").distinct().withColumn("hash", name_hash(F.col("name"), salt))
    tries = new.select("name", "hash", F.explode(F.sequence(F.lit(6), F.lit(32), F.lit(2))).alias("n"))
    tries = tries.withColumn("token", F.concat(F.lit(PREFIX), F.expr("substr(hash, 1, n)")))
    tries = tries.withColumn("turn", F.row_number().over(Window.partitionBy("token").orderBy("name"))).where("turn = 1")
    free = tries.join(ledger.select("token"), "token", "left_anti").groupBy("name").agg(F.min_by("token", "n").alias("token"))
    return new.join(free, "name", "left").select("name", F.coalesce("token", F.concat(F.lit(PREFIX), "hash")).alias("token"))


def removed_names(ledger: DataFrame) -> DataFrame:
    """(norm, token): normal forms of all names and variants; of several tokens for one the smallest."""
    variants = F.coalesce(F.from_json("variants", "array<string>"), F.array().cast("array<string>"))
    forms = ledger.select("token", F.explode(F.concat(F.array("name"), variants)).alias("name")).where("name is not null and name <> ''")
    return forms.groupBy(normal_name(F.col("name")).alias("norm")).agg(F.min("token").alias("token"))


def replace_in_lists(rows: DataFrame, column: str, ledger: DataFrame) -> DataFrame:
    """``rows`` whose ;-lists in ``column`` have tokens for removed names.

    Whole entries are compared, never parts of them; lists without such a name stay as they are, to the
    letter. Each distinct list is taken apart once, and only changed ones are put together again.
    """
    fixed, at, part, norm, old = unused(["fixed", "at", "part", "norm", "old"], rows, ledger)
    entries = rows.where(F.col(column).isNotNull()).select(F.col(column).alias(old)).distinct().select(old, F.posexplode(F.split(old, ";")).alias(at, part))
    entries = entries.withColumn(part, bare(F.col(part))).withColumn(norm, normal_name(F.col(part)))
    names = removed_names(ledger).withColumnRenamed("norm", norm)
    marked = entries.join(names, norm, "left").select(old, at, F.coalesce("token", part).alias(part), F.col("token").isNotNull().alias(norm))
    lists = marked.groupBy(old).agg(F.array_sort(F.collect_list(F.struct(at, part))).alias(fixed), F.max(norm).alias(norm)).where(F.col(norm))
    lists = lists.select(old, F.array_join(F.transform(fixed, lambda x: x[part]), "; ").alias(fixed))
    out = rows.join(lists, F.col(column) == F.col(old), "left")
    return out.withColumn(column, F.coalesce(fixed, column)).select(*rows.columns)


def replace_names(rows: DataFrame, column: str, ledger: DataFrame, clear: tuple[str, ...] = (), unique: tuple[str, ...] | None = None) -> DataFrame:
    """``rows`` with tokens for removed names in a column of single names, whose traces in ``clear`` go.

    Names are compared as they are written, as the tables' keys hold them. Rows that become equal in
    ``unique`` collapse into one.
    """
    (token,) = unused(["token"], rows)
    variants = F.coalesce(F.from_json("variants", "array<string>"), F.array().cast("array<string>"))
    exact = ledger.select("token", F.explode(F.concat(F.array("name"), variants)).alias(column)).groupBy(column).agg(F.min("token").alias(token))
    out = rows.join(exact, column, "left")
    for c in clear:
        out = out.withColumn(c, F.when(F.col(token).isNull(), F.col(c)))
    gone = out.where(F.col(token).isNotNull()).withColumn(column, F.col(token)).select(*rows.columns)
    kept = out.where(F.col(token).isNull()).select(*rows.columns)
    return kept.unionByName(gone.dropDuplicates(list(unique)) if unique else gone)


PASS = 200_000  #: name forms that one pass over free texts looks for
SHORTEST = 4  # fixed: characters of a name that is looked for in free texts


def name_forms(ledger: DataFrame) -> DataFrame:
    """(token, k, form): names, then variants, without blanks around them, each form of an entry once."""
    variants = F.coalesce(F.from_json("variants", "array<string>"), F.array().cast("array<string>"))
    return ledger.select("token", F.posexplode(F.array_distinct(F.filter(F.transform(F.concat(F.array("name"), variants), bare), lambda x: x != ""))).alias("k", "form"))


def scrub(rows: DataFrame, column: str, ledger: DataFrame, most: int = PASS) -> DataFrame:
    """``rows`` with tokens for the names, of 4 or more characters, that stand as whole words in a free text.

    Entries take their turns by token, their forms as listed, as if each went over the texts alone; tokens are not
    searched for names. More than ``most`` forms take several passes, so what tasks hold stays bounded.
    """
    forms = cut(name_forms(ledger).where(F.length("form") >= SHORTEST), "forms")
    count = forms.count()
    placed = ranked(forms, [F.col("token"), F.col("k")], "place") if count > most else forms
    for first in range(0, count, most):
        part = placed.where(F.col("place").between(first + 1, first + most)) if count > most else placed
        rows = replace_in_texts(rows, column, [Phrase(r["form"], r["token"]) for r in part.orderBy("token", "k").collect()])
    return rows


@dataclass(frozen=True)
class Stored:
    """How a table holds names: ;-lists, a key column with traces to clear and what makes rows equal, or free texts."""

    lists: tuple[str, ...] = ()
    name: str | None = None
    clear: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()


# Fixed: the tables of the index that hold names.
TABLES = {
    "articles": Stored(lists=("authors",)),
    "books": Stored(lists=("authors", "editors")),
    "authors": Stored(name="name", clear=("orcid", "openalex_id", "institution_name", "institution_ror"), unique=("name",)),
    "author_article_affiliations": Stored(name="author_name", clear=("openalex_author_id",), unique=("article_id", "author_name")),
    "article_author_institutions": Stored(name="author_name", clear=("openalex_author_id",), unique=("article_id", "author_name", "institution_id")),
    "citations": Stored(texts=("raw_reference",)),
}


def sweep(tables: dict[str, DataFrame], ledger: DataFrame, stored: dict[str, Stored] = TABLES) -> dict[str, DataFrame]:
    """The tables with tokens for all names of the ledger: each table once, for all entries together.

    Doing it again changes nothing. Columns that a table lacks are passed over.
    """
    out = {}
    for table, rows in tables.items():
        how = stored[table]
        for column in (c for c in how.lists if c in rows.columns):
            rows = replace_in_lists(rows, column, ledger)
        if how.name:
            rows = replace_names(rows, how.name, ledger, tuple(c for c in how.clear if c in rows.columns), how.unique)
        for column in (c for c in how.texts if c in rows.columns):
            rows = scrub(rows, column, ledger)
        out[table] = rows
    return out


def restore(rows: DataFrame, column: str, entries: DataFrame, most: int = PASS) -> DataFrame:
    """``rows`` with the tokens of ``entries(token, name)`` turned back into names, in lists and texts alike.

    A token that begins another one is looked for after it. At most ``most`` entries at a time.
    """
    found = entries.select("token", "name").orderBy(F.desc(F.length("token")), "token").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} entries; restore them in parts")
    return replace_in_texts(rows, column, [Phrase(r["token"], r["name"], whole=False) for r in found])


def undo(tables: dict[str, DataFrame], ledger: DataFrame, tokens: DataFrame, stored: dict[str, Stored] = TABLES) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables with the names behind ``tokens(token)`` again, and the ledger without their entries.

    Lists and key columns get the name back; cleared traces are gone, and free texts keep their tokens.
    """
    entries = ledger.join(tokens.select("token").distinct(), "token", "left_semi")
    out = {}
    for table, rows in tables.items():
        how = stored[table]
        for column in (c for c in how.lists if c in rows.columns):
            rows = restore(rows, column, entries)
        if how.name:
            (back,) = unused(["back"], rows)
            names = entries.select(F.col("token").alias(how.name), F.col("name").alias(back))
            rows = rows.join(names, how.name, "left").withColumn(how.name, F.coalesce(back, how.name)).select(*rows.columns)
        out[table] = rows
    return out, ledger.join(entries.select("token"), "token", "left_anti").select(*ledger.columns)


def export_ledger(ledger: DataFrame, path: str, salt: str) -> None:
    """The ledger as JSON lines, with the hashes of its names."""
    ledger.withColumn("name_hash", name_hash(F.col("name"), salt)).write.json(path)


def import_ledger(ledger: DataFrame, path: str) -> DataFrame:
    """The ledger merged with an exported one; doing it again changes nothing."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ledger.schema.fields)
    return merge_ledger(ledger, ledger.sparkSession.read.schema(schema).json(path))


def suppressed(batch: DataFrame, ledger: DataFrame | None, lists: tuple[str, ...] = ("authors", "editors")) -> DataFrame:
    """A harvest as it may enter the index: removed names are tokens already."""
    for column in lists if ledger is not None else ():
        if column in batch.columns:
            batch = replace_in_lists(batch, column, ledger)
    return batch


def merge_ledger(ledger: DataFrame, more: DataFrame) -> DataFrame:
    """The ledger with entries of an export whose tokens it lacks; of equal tokens the first name counts."""
    fresh = more.join(ledger.select("token"), "token", "left_anti").withColumn("_k", F.row_number().over(Window.partitionBy("token").orderBy("name"))).where("_k = 1")
    return ledger.unionByName(fresh.select(*ledger.columns))


def listing(ledger: DataFrame) -> DataFrame:
    return ledger.orderBy(F.desc("removed_at"), "token")


def surname_match(claimed: Column, verified: Column) -> Column:
    """Whether two names share a word of two or more characters."""
    words = lambda n: F.filter(F.split(normal_name(n), " "), lambda w: F.length(w) > 1)
    return F.coalesce(F.arrays_overlap(words(claimed), words(verified)), F.lit(False))


def open_requests(requests: DataFrame, asked: DataFrame) -> DataFrame:
    """Requests (request, name, email, orcid, method, status, token_hash) with new ones pending; requests
    by mail wait for a token, of which only the hash is kept."""
    new = asked.select("request", "name", "email", "orcid", "method", F.lit("pending").alias("status"), F.when(F.col("method") == "email", F.sha2("secret", 256)).alias("token_hash"))
    return requests.unionByName(new.join(requests.select("request"), "request", "left_anti"))


def verify(requests: DataFrame, secrets: DataFrame) -> DataFrame:
    """Requests whose one-time secret came back are verified, and the secret is spent."""
    shown_ = secrets.select(F.sha2("secret", 256).alias("token_hash")).distinct().withColumn("_hit", F.lit(True))
    out = requests.join(shown_, "token_hash", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return out.withColumn("status", F.when(hit, "verified").otherwise(F.col("status"))).withColumn("token_hash", F.when(~hit, F.col("token_hash"))).select(*requests.columns)


def attach(requests: DataFrame, proofs: DataFrame) -> DataFrame:
    """Requests with proofs(request, verified_orcid, verified_name): verified, and whether the names agree."""
    out = requests.join(proofs, "request", "left")
    agrees = F.when(F.col("verified_name").isNotNull(), surname_match(F.col("name"), F.col("verified_name")))
    proved = F.col("verified_name").isNotNull() | F.col("verified_orcid").isNotNull()
    out = out.withColumn("orcid", F.coalesce("verified_orcid", "orcid")).withColumn("status", F.when(proved, "verified").otherwise(F.col("status")))
    return out.select(*requests.columns, agrees.alias("agrees"))

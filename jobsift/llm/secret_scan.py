"""Secrets in texts, told apart by how many repositories and owners share them.

Every text gives base spans (assignments, access keys, long hex strings) and weak candidates:
opaque strings outside the base spans, whose characters look drawn at random: they are of
three classes, change between them often and have a high entropy, unlike words that slashes
or hyphens join.  The values of all of them are hashed and counted over the whole corpus by
distinct repositories and owners.  A value that several owners or very many repositories have
was copied from somewhere, such as an example key in documentation; one that belongs to one
owner and few repositories looks like a live credential.  All spans stay and are marked so.

Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsift.llm.spans import matches_with_start
from jobsift.session import materialize

# The kinds of spans in their order, and their patterns.
KINDS = ["assign", "access", "hex", "opaque"]
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
    r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
OPAQUE = r"[A-Za-z0-9+/_=-]{20,}"
CLASSES = r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
LEAST_VALUE = 8
#: An opaque string has so many characters at most (longer ones are encoded data), so many tenths
#: as many runs of a class as characters (a capital belongs to the letters behind it), and so many bits of entropy a character at least.
MOST_OPAQUE = 200
LEAST_TENTHS = 3
LEAST_ENTROPY = 3.0
#: Values that are called live belong to this many owners and repositories at most.
LIVE_OWNERS = 1
LIVE_REPOSITORIES = 10


def _rows(text: Column, kind: str, pattern: str, group: int, likely: Column) -> Column:
    """``array<struct<start, kind, end, value>>`` of one kind."""
    number = KINDS.index(kind)
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    return F.when(likely, F.transform(
        matches_with_start(text, pattern, group),
        lambda x: F.struct(
            x["start"].alias("start"), F.lit(number).alias("kind"),
            (x["start"] + F.length(x["m"])).alias("end"), x["v"].alias("value")))).otherwise(none)


def base_spans(text: Column) -> Column:
    """Assignments, access keys and hex strings; null gives none."""
    low = F.lower(text)
    named = low.contains(ASSIGN_WORDS[0])
    for word in ASSIGN_WORDS[1:]:
        named = named | low.contains(word)
    assign = F.filter(_rows(text, "assign", ASSIGN, 2, named), lambda x: F.length(x["value"]) >= LEAST_VALUE)
    return F.concat(
        assign, _rows(text, "access", ACCESS, 0, text.contains("AKIA")),
        _rows(text, "hex", HEX, 0, F.regexp_like(text, F.lit(HEX))))


def entropy(value: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for the empty string."""
    n = F.length(value)
    signs = F.filter(F.split(value, ""), lambda c: c != "")
    counts = F.transform(F.array_distinct(signs), lambda c: n - F.length(F.replace(value, c, F.lit(""))))
    bits = F.aggregate(counts, F.lit(0.0), lambda a, k: a + k * F.log2(k.cast("double")))
    return F.when(n > 0, F.log2(n.cast("double")) - bits / n).otherwise(0.0)


def _random_looking(value: Column) -> Column:
    mixed = F.regexp_like(value, F.lit("[0-9]")) & F.regexp_like(value, F.lit("[a-z]")) & F.regexp_like(value, F.lit("[A-Z]"))
    changes = F.regexp_count(value, F.lit(CLASSES)) * 10 >= F.length(value) * LEAST_TENTHS
    return mixed & (F.length(value) <= MOST_OPAQUE) & changes & F.when(mixed & changes, entropy(value) >= LEAST_ENTROPY).otherwise(False)


def _opaque_spans(text: Column, base: Column) -> Column:
    """Random-looking strings outside the base spans."""
    found = _rows(text, "opaque", OPAQUE, 0, F.regexp_like(text, F.lit(r"[0-9]")) & F.regexp_like(text, F.lit(OPAQUE)))
    return F.filter(found, lambda x: _random_looking(x["value"]) & ~F.exists(
        base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    owner_col: str = "source", repository_col: str = "doc_id", live_owners: int = LIVE_OWNERS,
    live_repositories: int = LIVE_REPOSITORIES,
) -> DataFrame:
    """One row per row of ``docs``: ``(id, spans, n_assign, n_access, n_hex, n_opaque, n_live, n_shared)``.

    ``spans`` is ``array<struct<start, kind, end, value_hash, n_owners, n_repositories, live>>``
    in the order of start, then kind (a number in ``KINDS``); places count code points and
    ends are exclusive.  ``live`` says that at most ``live_owners`` owners and
    ``live_repositories`` repositories have the value; spans that are not live are shared.
    Null texts count as empty.  A null owner or repository counts as one of its own.
    Rows that repeat an id are scanned each for itself.  Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = lambda spans: F.transform(spans, lambda x: F.struct(
        x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.sha2(x["value"], 256).alias("value_hash")))
    found = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col(owner_col).cast("string")), F.lit("")).alias("owner"),
        F.coalesce(F.concat(F.lit("="), F.col(repository_col).cast("string")), F.lit("")).alias("repository"),
        text.alias("text"))
    found = found.withColumn("base", base_spans(F.col("text"))).withColumn("weak", _opaque_spans(F.col("text"), F.col("base")))
    # Written once, the row numbers hold for good.
    found = materialize(found.select(
        F.monotonically_increasing_id().alias("row"), "id", "owner", "repository",
        hashed(F.col("base")).alias("base"), hashed(F.col("weak")).alias("weak")), "secrets")

    values = found.select("row", "owner", "repository", F.explode(F.concat("base", "weak")).alias("s"))
    shared = ownership(values.select(F.col("s.value_hash").alias("value_hash"), "owner", "repository"))
    marked = values.join(shared, values["s.value_hash"] == shared["value_hash"]).select(
        "row", F.struct(
            "s.start", "s.kind", "s.end", "s.value_hash", "n_owners", "n_repositories",
            ((F.col("n_owners") <= live_owners) & (F.col("n_repositories") <= live_repositories)).alias("live")).alias("s"))
    spans = marked.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    of_kind = lambda n: F.size(F.filter("spans", lambda x: x["kind"] == n)).cast("long")
    out = found.select("row", "id").join(spans, "row", "left").withColumn(
        "spans", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)))
    live = F.size(F.filter("spans", lambda x: x["live"])).cast("long")
    return out.select(
        "id", "spans", *(of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        live.alias("n_live"), (F.size("spans") - live).cast("long").alias("n_shared"))


def ownership(values: DataFrame) -> DataFrame:
    """``(value_hash, n_owners, n_repositories)`` of ``values(value_hash, owner, repository)``.

    Distinct owners and repositories are found before a value's rows meet, so a value that a
    third of all rows hold is counted from partial sums.
    """
    seen = values.select("value_hash", "owner", "repository").distinct()
    owners = seen.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    repositories = seen.groupBy("value_hash", "repository").agg(F.lit(1).alias("one"))
    return (
        owners.groupBy("value_hash").agg(F.count(F.lit(1)).alias("n_owners"))
        .join(repositories.groupBy("value_hash").agg(F.count(F.lit(1)).alias("n_repositories")), "value_hash"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(F.lit(KINDS), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda x: x["kind"] < KINDS.index("opaque"))

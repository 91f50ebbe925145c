"""Submission documents: built from a report, parsed and cleaned on arrival."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from assentlake import fixed
from assentlake.functions.binding import bind, once
from assentlake.functions.scores import per_thousand, reconcile_mdi
from assentlake.functions.text import trim_all
from assentlake.functions.variants import array_at, json_variant, string_at

V = "v"
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"

ENTRY = "struct<name:string,hits:bigint,messages:bigint,mdi:double>"


def _own_text(sub: Column, kind: Column) -> Column:
    """The trimmed text of a variant that is a string."""
    return F.when(kind == "STRING", trim_all(sub.cast("string")))


def _value(sub: Column, kind: Column, text: Column) -> Column:
    """A variant as a number, NULL for what is none. Numeric text counts as a number."""
    numeric = F.when(text == "", F.lit(0.0)).when(text.rlike(NUMBER), text.try_cast("double"))
    return (
        F.when(kind == "STRING", numeric)
        .when(kind == "BOOLEAN", F.when(F.try_variant_get(sub, "$", "boolean"), 1.0).otherwise(0.0))
        .when(kind == "VOID", F.lit(0.0))
        .otherwise(F.try_variant_get(sub, "$", "double"))
    )


def _usable(x: Column) -> Column:
    return F.when((x >= 0) & (x < float("inf")), x)


def _whole(x: Column) -> Column:
    return F.floor(F.least(F.coalesce(x, F.lit(0.0)), F.lit(9.0e18))).cast("bigint")


def number_at(v: Column | str, path: str) -> Column:
    """Finite, non-negative number at the path, else NULL."""

    def read(sub: Column) -> Column:
        return bind(F.schema_of_variant(sub), lambda kind: bind(_own_text(sub, kind), lambda text: _value(sub, kind, text)))

    return bind(bind(F.try_variant_get(v, path, "variant"), read), _usable)


def count_at(v: Column | str, path: str) -> Column:
    """Non-negative integer at the path, 0 for anything else."""
    return _whole(number_at(v, path))


def with_numbers(rows: DataFrame, *names: str) -> DataFrame:
    """Replace variants by finite, non-negative numbers, NULL for anything else.

    Step by step in plain columns: what a later step uses several times is computed once.
    """
    steps = (
        lambda n: {f"_kind_{n}": F.schema_of_variant(n)},
        lambda n: {f"_text_{n}": _own_text(F.col(n), F.col(f"_kind_{n}"))},
        lambda n: {f"_value_{n}": _value(F.col(n), F.col(f"_kind_{n}"), F.col(f"_text_{n}"))},
        lambda n: {n: _usable(F.col(f"_value_{n}"))},
    )
    for step in steps:
        rows = rows.withColumns({k: c for n in names for k, c in step(n).items()})
    return rows.drop(*(f"_{part}_{n}" for part in ("kind", "text", "value") for n in names))


def name_at(v: Column | str, path: str, limit: int) -> Column:
    return F.substring(trim_all(F.coalesce(string_at(v, path), F.lit(""))), 1, limit)


@dataclass(frozen=True)
class Listing:
    """Where a document lists its rows: the key, what a row calls its name, and the limits."""

    key: str
    name: str
    limit: int
    name_limit: int


MODELS = Listing("modelEntries", "model", fixed.MAX_MODEL_ENTRIES, fixed.MAX_MODEL_NAME)
HARNESSES = Listing("harnessEntries", "harness", fixed.MAX_HARNESS_ENTRIES, fixed.MAX_HARNESS_NAME)


def _plain(listing: Listing) -> str:
    """Pattern of the kind of a list whose rows hold a text as name and numbers, and nothing else."""
    number = r"(?:BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))"
    kinds = {listing.name: "STRING", "droolCount": number, "totalMessages": number, "mdi": number}
    return r"^ARRAY<OBJECT<" + ", ".join(f"{key}: {kinds[key]}" for key in sorted(kinds)) + r">>\z"


def _entries(listing: Listing, plain: str, listed: str) -> Column:
    """The clean rows of a list: from the column ``plain`` of rows, where it is NULL from the variant ``listed``."""

    def head(rows: Column) -> Column:
        return F.slice(rows, F.lit(1), F.lit(listing.limit))

    def read(e: Column) -> Column:
        return F.struct(
            name_at(e, f"$.{listing.name}", listing.name_limit).alias("name"),
            count_at(e, "$.droolCount").alias("hits"),
            count_at(e, "$.totalMessages").alias("messages"),
            number_at(e, "$.mdi").alias("mdi"),
        )

    def read_plain(e: Column) -> Column:
        # A missing rate is NULL, a JSON null counts as 0.
        rate = F.when(F.is_variant_null(e["mdi"]), 0.0).otherwise(F.try_variant_get(e["mdi"], "$", "double"))
        return F.struct(
            F.substring(trim_all(F.coalesce(e[listing.name], F.lit(""))), 1, listing.name_limit).alias("name"),
            _whole(_usable(e["droolCount"])).alias("hits"),
            _whole(_usable(e["totalMessages"])).alias("messages"),
            bind(rate, _usable).alias("mdi"),
        )

    def checked(e: Column) -> Column:
        return F.struct(
            e["name"].alias("name"),
            e["hits"].alias("hits"),
            e["messages"].alias("messages"),
            reconcile_mdi(e["mdi"], e["hits"], e["messages"]).alias("mdi"),
        )

    found = F.coalesce(F.transform(head(F.col(plain)), read_plain), F.transform(head(array_at(listed, "$")), read))
    named = F.filter(found, lambda e: e["name"] != "")
    return F.coalesce(F.transform(named, checked), F.from_json(F.lit("[]"), f"array<{ENTRY}>"))


def with_entries(docs: DataFrame, **listings: Listing) -> DataFrame:
    """Add a column for each listing: the clean rows of the document ``v`` as one array.

    Where all rows of a list hold a text and numbers, which its kind tells at once, they are read
    together; in any other list each value is looked at by itself.
    """
    lists = {f"_list_{c}": F.try_variant_get(V, f"$.{listing.key}", "variant") for c, listing in listings.items()}
    together = {
        f"_rows_{c}": F.when(
            F.schema_of_variant(f"_list_{c}").rlike(_plain(listing)),
            F.try_variant_get(
                f"_list_{c}",
                "$",
                f"array<struct<{listing.name}: string, droolCount: double, totalMessages: double, mdi: variant>>",
            ),
        )
        for c, listing in listings.items()
    }
    clean = {c: _entries(listing, f"_rows_{c}", f"_list_{c}") for c, listing in listings.items()}
    return docs.withColumns(lists).withColumns(together).withColumns(clean).drop(*lists, *together)


def documents(raw: DataFrame, column: str = "payload_json") -> DataFrame:
    """Add ``v``, the parsed document, NULL for what is none."""
    return once(raw, V, _document(F.col(column)))


def entry_rows(docs: DataFrame, listing: Listing, first_only: bool = False) -> DataFrame:
    """The columns of ``docs`` but v, and name, hits, messages, mdi of each row a document lists.

    The document is unfolded first and its numbers are read from plain columns after that. Rows
    behind the limit and rows without a name are left out. With ``first_only`` a name that is
    repeated in a document counts once, by its first row.
    """
    keys = [c for c in docs.columns if c != V]
    listed = docs.select(*keys, F.try_variant_get(V, f"$.{listing.key}", "variant").alias("_list"))
    if first_only:
        names = F.transform(
            F.slice(array_at("_list", "$"), F.lit(1), F.lit(listing.limit)),
            lambda e: name_at(e, f"$.{listing.name}", listing.name_limit),
        )
        listed = listed.withColumn("_names", names)
    rows = listed.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("_list").outer()))
    # An object has keys, an array has none.
    rows = rows.where(F.col("key").isNull() & (F.col("pos") < listing.limit)).select(
        *(c for c in listed.columns if c != "_list"),
        "pos",
        name_at("value", f"$.{listing.name}", listing.name_limit).alias("name"),
        *(F.try_variant_get("value", f"$.{n}", "variant").alias(n) for n in ("droolCount", "totalMessages", "mdi")),
    )
    if first_only:
        rows = rows.where(F.array_position("_names", F.col("name")) == F.col("pos") + 1)
    numbers = ("droolCount", "totalMessages", "mdi")
    counted = with_numbers(rows.where(F.col("name") != "").select(*keys, "name", *numbers), *numbers).select(
        *keys, "name", _whole(F.col("droolCount")).alias("hits"), _whole(F.col("totalMessages")).alias("messages"), "mdi"
    )
    return counted.withColumn("mdi", reconcile_mdi(F.col("mdi"), F.col("hits"), F.col("messages")))


def sanitize(parsed: DataFrame, keep: bool = False) -> DataFrame:
    """Replace the document ``v`` by clean columns; a missing document gives an empty report.

    With ``keep`` the document stays, for the rows it lists.
    """
    numbers = {
        "hits": "droolCount",
        "messages": "assistantMessages",
        "mdi": "mdi",
        "sessions_scanned": "sessionsScanned",
        "generated_at": "generatedAt",
    }
    found = {name: F.try_variant_get(V, f"$.{key}", "variant") for name, key in numbers.items()}
    counted = with_numbers(parsed.withColumns(found), *numbers).withColumns(
        {name: _whole(F.col(name)) for name in numbers if name != "mdi"}
    )
    clean = (
        counted.withColumn("version", name_at(V, "$.version", fixed.MAX_VERSION))
        .withColumn("mdi", reconcile_mdi(F.col("mdi"), F.col("hits"), F.col("messages")))
    )
    clean = with_entries(clean, model_entries=MODELS, harness_entries=HARNESSES).withColumn(
        "model_count", F.size("model_entries")
    )
    return clean if keep else clean.drop(V)


def _document(text: Column) -> Column:
    """The parsed text if it is a JSON object, else NULL."""
    return F.when(F.ltrim(text, F.lit("\t\n\r ")).startswith("{"), json_variant(text))


def parse_payloads(raw: DataFrame, column: str = "payload_json") -> DataFrame:
    """Add ``accepted`` and the clean columns; rejected rows keep their raw text."""
    return sanitize(documents(raw, column).withColumn("accepted", F.col(V).isNotNull()))


def stored_payloads(stored: DataFrame, column: str = "payload_json") -> DataFrame:
    """Payloads read back from history; a damaged one becomes an empty report."""
    return sanitize(documents(stored, column))


def _entry_json(entries: Column, name: str) -> Column:
    return F.transform(
        entries,
        lambda e: F.struct(
            e["name"].alias(name),
            e["hits"].alias("droolCount"),
            e["messages"].alias("totalMessages"),
            e["mdi"].alias("mdi"),
        ),
    )


def payload_json() -> Column:
    """The clean columns as one document, in the field names of the submission format."""
    return F.to_json(
        F.struct(
            F.col("version"),
            F.col("hits").alias("droolCount"),
            F.col("messages").alias("assistantMessages"),
            F.col("mdi"),
            F.col("sessions_scanned").alias("sessionsScanned"),
            F.col("model_count").alias("modelCount"),
            _entry_json(F.col("model_entries"), "model").alias("modelEntries"),
            _entry_json(F.col("harness_entries"), "harness").alias("harnessEntries"),
            F.col("generated_at").alias("generatedAt"),
        )
    )


def build_payload(
    totals: DataFrame, models: DataFrame, harnesses: DataFrame, sessions: DataFrame, version: str, generated_at: Column
) -> DataFrame:
    """One submission document of a report: counts and names, no text and no session.

    The inputs are finished rollups, one row per model and per agent.
    """
    def listed(rows: DataFrame, name: str, order: list[Column]) -> DataFrame:
        entry = F.struct(F.col(name).alias("name"), "hits", "messages", "mdi")
        return rows.agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct(*order, entry.alias("entry")))), lambda r: r["entry"]
            ).alias("entries")
        )

    model_rows = listed(
        models, "model", [(-F.col("hits")).alias("a"), (-F.col("mdi")).alias("b"), F.col("model").alias("c")]
    ).withColumnRenamed("entries", "model_entries")
    harness_rows = listed(
        harnesses.where(F.col("messages") > 0), "name", [F.col("name").alias("a")]
    ).withColumnRenamed("entries", "harness_entries")
    one_row = (
        totals.select("hits", "messages", per_thousand(F.col("hits"), F.col("messages")).alias("mdi"))
        .crossJoin(sessions.select(F.col("sessions").alias("sessions_scanned")))
        .crossJoin(model_rows)
        .crossJoin(harness_rows)
        .withColumn("version", F.lit(version))
        .withColumn("model_count", F.size("model_entries"))
        .withColumn("generated_at", F.unix_millis(generated_at))
    )
    return one_row.select(payload_json().alias("payload_json"))


def explode_entries(docs: DataFrame, listing: Listing) -> DataFrame:
    """Child rows (submission_id, user_id, name, hits, messages, mdi, created_at) of parsed documents."""
    rows = entry_rows(docs.select("submission_id", "user_id", "created_at", V), listing, first_only=True)
    return rows.select(
        "submission_id", "user_id", F.col("name").alias(listing.name), "hits", "messages", "mdi", "created_at"
    )


def listed_entries(clean: DataFrame, listing: Listing) -> DataFrame:
    """The rows of explode_entries from the clean columns of documents that were read already."""
    entries = F.col("model_entries" if listing == MODELS else "harness_entries")
    keys = ("submission_id", "user_id", "created_at")
    # The first row of a name counts.
    rows = clean.select(*keys, F.transform(entries, lambda e: e["name"]).alias("_names"), F.posexplode(entries).alias("pos", "e"))
    rows = rows.where(F.array_position("_names", F.col("e.name")) == F.col("pos") + 1)
    return rows.select("submission_id", "user_id", F.col("e.name").alias(listing.name), "e.hits", "e.messages", "e.mdi", "created_at")

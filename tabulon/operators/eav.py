"""Attribute-value rows into wide tables (problem 5).

Every (entity, attribute) cell is a slot register. Registers are combined with RDD
``combineByKey``, whose keys are the entities (vintage, iso, year) and whose combiners are an
entity's registers, slot by slot: the merge is associative (latest load wins, then the
smallest id), so duplicates and revisions are resolved on the map side before anything is
shuffled, and an entity never holds more than one register per attribute. A hot iso is spread
over its (vintage, year) entities. Spark's combiner spills to disk. Codes, forms and missing
markers are judged by Catalyst before; typed encoders then emit one full row per entity.

Defined results: rows without vintage, iso, year or attribute fill no cell; a missing
loaded_at is older than any other; rows sent twice resolve to the smallest id; an entity all
of whose cells are empty still gets a row; an empty table gives an empty table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of a missing value (compared without outer blanks, in capitals); types of the codes that are no numbers.
MISSING = ["", "N/A", "--", "-", "NA"]
TYPES = {"EST_AFTER": "int", "REV_DATE": "date", "BASE_NOTE": "string", "METHOD": "string"}
NUMBER = r"^[+-]?((\d{1,3}(,\d{3})+|\d+)(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
DATE = r"^\d{4}-\d{2}-\d{2}$"

#: Rows meant for one partition of the combine, and the most attributes a wide table may have.
PARTITION_ROWS = 500_000
MAX_CODES = 5_000
#: Load time of a row without one.
OLDEST = -(1 << 63)


def observations(obs: DataFrame, types: dict[str, str] = TYPES) -> DataFrame:
    """(vintage, iso, yr, code, t, obs_id, v): annual rows, codes squeezed, v null where the value is missing or of the wrong form."""
    squeeze = lambda c: F.upper(F.translate(c, " \t\n\x0b\f\r", ""))
    x = obs.select("vintage", "yr", "obs_id", "val", F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("t"), F.split(squeeze(F.col("series_code")), r"\.").alias("s"), squeeze(F.col("iso")).alias("i"), squeeze(F.col("weo_subject_code")).alias("w"))
    has, part = F.col("s").isNotNull(), lambda k: F.coalesce(F.get("s", F.lit(k)), F.lit(""))
    x = x.filter(~has | (part(2) == "A")).select("vintage", F.when(has, part(0)).otherwise(F.col("i")).alias("iso"), "yr", F.when(has, part(1)).otherwise(F.col("w")).alias("code"), "t", "obs_id", F.btrim("val", F.lit(" \t")).alias("v"))
    x = x.filter("vintage is not null and yr is not null and obs_id is not null and iso <> '' and code <> ''")
    number = F.when(F.col("v").rlike(NUMBER), F.translate("v", ",", ""))
    form: Column = number
    for name, kind in types.items():
        own = {"string": F.col("v"), "date": F.when(F.col("v").rlike(DATE) & F.try_to_date("v", "yyyy-MM-dd").isNotNull(), F.col("v")), "int": F.when(F.col("v").rlike(r"^[+-]?\d{1,9}$"), F.regexp_replace("v", r"\+", ""))}[kind]
        form = F.when(F.col("code") == name, own).otherwise(form)
    gone = (F.length("v") <= max(map(len, MISSING))) & F.upper("v").isin(MISSING)
    return x.withColumn("v", F.when(~gone, form))


# A register is (slot, load time, minus the id, value) of the row that holds the cell.
Register = tuple[int, int, int, str | None]


def register(row: Register) -> dict[int, Register]:
    """createCombiner: the registers of an entity that has one row."""
    return {row[0]: row}


def put(held: dict[int, Register], row: Register) -> dict[int, Register]:
    """mergeValue: one more row of the entity."""
    old = held.get(row[0])
    if old is None or row[1] > old[1] or (row[1] == old[1] and beats(row, old)):
        held[row[0]] = row
    return held


def beats(new: Register, old: Register) -> bool:
    """Among rows loaded at the same time the smallest id wins, then a value over none, then the smaller value."""
    if new[2] != old[2]:
        return new[2] > old[2]
    return new[3] is not None and (old[3] is None or new[3] < old[3])


def merge(a: dict[int, Register], b: dict[int, Register]) -> dict[int, Register]:
    """mergeCombiners: registers of the same entity from two partitions; associative and commutative."""
    for row in b.values():
        put(a, row)
    return a


def registers(x: DataFrame, slots: dict[str, int], partitions: int):
    """RDD of ("vintage|iso|yr", {slot: register}) from ``observations``."""
    slot = F.create_map(*[F.lit(v) for kv in slots.items() for v in kv])
    rows = x.select(F.concat_ws("|", "vintage", "iso", "yr"), slot[F.col("code")], F.coalesce("t", F.lit(OLDEST)), -F.col("obs_id"), "v").rdd
    return rows.map(lambda r: (r[0], r[1:])).combineByKey(register, put, merge, numPartitions=partitions)


ENCODERS = {"double": float, "int": int, "date": dt.date.fromisoformat, "string": str}


def encoder(kinds: list[str]):
    """Typed encoder: one entity's registers to its full row, empty cells null, and the ids that supply the cells."""
    read = [ENCODERS[k] for k in kinds]

    def row(kv: tuple) -> tuple:
        vintage, rest = kv[0].split("|", 1)
        iso, yr = rest.rsplit("|", 1)
        values, ids = [None] * len(read), [None] * len(read)
        for slot, _, minus_id, v in kv[1].values():
            if v is not None:
                values[slot], ids[slot] = read[slot](v), -minus_id
        return (int(vintage), iso, int(yr), *values, ids)

    return row


def codes_of(x: DataFrame) -> tuple[list[str], int]:
    """(the attribute codes, rows). They become columns, so their number is bounded by what a table can have."""
    known = x.groupBy("code").count().limit(MAX_CODES + 1).collect()
    if len(known) > MAX_CODES:
        raise ValueError(f"more than {MAX_CODES} attribute codes; use found(), which has a row per cell")
    return sorted(r["code"] for r in known), sum(r["count"] for r in known)


def wide(obs: DataFrame, types: dict[str, str] = TYPES) -> tuple[DataFrame, list[str]]:
    """(one row per vintage, iso and yr with a typed column per code and ``obs_ids``, the ids that supply each cell in the order of the codes; the codes)."""
    spark = obs.sparkSession
    x = observations(obs, types)
    codes, n = codes_of(x)
    kinds = [types.get(c, "double") for c in codes]
    schema = ", ".join(["vintage int", "iso string", "yr int", *(f"`{c}` {k}" for c, k in zip(codes, kinds, strict=True)), "obs_ids array<bigint>"])
    if not codes:
        return spark.createDataFrame([], schema), codes
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // PARTITION_ROWS + 1)
    r = registers(x, {c: i for i, c in enumerate(codes)}, partitions)
    return spark.createDataFrame(r.map(encoder(kinds)), schema, verifySchema=False), codes


def found(obs: DataFrame, types: dict[str, str] = TYPES) -> DataFrame:
    """(vintage, iso, yr, subject_code, obs_id): the filled cells of the wide table and the row that supplies each."""
    table, codes = wide(obs, types)
    names = F.array(*map(F.lit, codes)) if codes else F.array().cast("array<string>")
    cells = table.select("vintage", "iso", "yr", F.posexplode("obs_ids").alias("slot", "obs_id")).filter("obs_id is not null")
    return cells.select("vintage", "iso", "yr", F.get(names, F.col("slot")).alias("subject_code"), "obs_id")

"""Keys, canonical values, hashes and safe parsing (Column expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Role words for each side, split names, valid role pairs.
ROLE_A = ["A", "SPEAKER", "USER", "0"]
ROLE_B = ["B", "LISTENER", "ASSISTANT", "1"]
DEV_NAMES = ["valid", "validation"]
ROLE_PAIRS = ["A2B", "B2A", "A2A", "B2B"]

# Largest table that operators agree to broadcast; beyond it the join is left to AQE.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a dimension table, only after its row count was checked.

    At most `max_rows + 1` rows are counted.  A larger table comes back without a hint, so the join
    shuffles and adaptive execution handles skew.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def hash60(*parts: Column) -> Column:
    """First 15 hex digits of md5 over the parts joined by a vertical bar, as bigint."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def canonical_split(c: Column) -> Column:
    name = F.lower(F.trim(c))
    return F.when(name.isin(DEV_NAMES), F.lit("dev")).otherwise(name)


def canonical_role(role: Column, turn: Column) -> Column:
    word = F.upper(F.trim(role))
    parity = F.when(F.pmod(turn, F.lit(2)) == 0, F.lit("A")).otherwise(F.lit("B"))
    return F.when(word.isin(ROLE_A), F.lit("A")).when(word.isin(ROLE_B), F.lit("B")).otherwise(parity)


def item_key(split: Column, conv: Column, turn: Column) -> Column:
    return F.concat_ws("|", split, conv.cast("string"), turn.cast("string"))


def role_pair(source: Column, target: Column) -> Column:
    """`A2B`-style pair, null unless it is one of the four valid pairs."""
    pair = F.concat(F.upper(F.trim(source)), F.lit("2"), F.upper(F.trim(target)))
    return F.when(pair.isin(ROLE_PAIRS), pair)


def order_key(c: Column) -> Column:
    """Sort struct of an order-like text: numeric value, else first digit run, else +inf; then the text."""
    text = c.cast("string")
    as_number = text.try_cast("double")
    digits = F.regexp_extract(text, "[0-9]+", 0)
    number = F.when(
        as_number.isNotNull() & ~F.isnan(as_number) & (F.abs(as_number) < float("inf")),
        F.when(as_number < 0, F.ceil(as_number)).otherwise(F.floor(as_number)).cast("double"),
    ).when(F.length(digits) > 0, digits.cast("double"))
    return F.struct(F.coalesce(number, F.lit(float("inf"))).alias("number"), text.alias("text"))


def finite_double(c: Column) -> Column:
    """Double or null; NaN and infinities become null."""
    d = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def int_via_double(c: Column) -> Column:
    d = finite_double(c)
    return F.when(d < 0, F.ceil(d)).otherwise(F.floor(d)).cast("long")


def tolerant_bool(c: Column) -> Column:
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin("1", "true", "yes", "y"), F.lit(True)).when(
        word.isin("0", "false", "no", "n", ""), F.lit(False)
    )


def first_filled(*cols: Column) -> Column:
    """First argument that is neither null nor blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in cols])


def stable_id(prefix: str, *parts: Column) -> Column:
    """Prefix, underscore and 16 hex digits of SHA-1 over the parts joined by newlines."""
    text = F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(text), 1, 16))


def agreement_rank(bucket: Column) -> Column:
    """Order of the agreement buckets, larger means closer agreement."""
    return (
        F.when(bucket == "4_of_4", 4).when(bucket == "3_of_4", 3).when(bucket == "2_of_4", 2)
        .when(bucket == "all_different", 1)
    )

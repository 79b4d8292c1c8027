"""Keys of the grid: packed positions, regions, slots, dimension folders and areas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells along one side of a region, and the shift from a cell to its region.
REGION_SIDE, REGION_SHIFT = 32, 5
LOW = 4294967295
#: Limits of areas: cells of an offline restore; radius of an online one, and cells that need confirming.
MAX_CELLS, MAX_RADIUS, CONFIRM_CELLS, CONFIRM_MS = 10_000, 8, 9, 30_000


def pack(x: Column, z: Column) -> Column:
    """x in the low and z in the high 32 bits of a long."""
    return x.cast("long").bitwiseAND(F.lit(LOW)).bitwiseOR(F.shiftleft(z.cast("long").bitwiseAND(F.lit(LOW)), 32))


def unpack_x(pos: Column) -> Column:
    low = pos.bitwiseAND(F.lit(LOW))
    return F.when(low >= 2147483648, low - 4294967296).otherwise(low)


def unpack_z(pos: Column) -> Column:
    return F.shiftright(pos, 32)


def region(cell: Column) -> Column:
    """The region of a cell; negative cells go down."""
    return F.shiftright(cell, REGION_SHIFT)


def slot(x: Column, z: Column) -> Column:
    """A cell's place, 0 to 1023, in its region."""
    side = F.lit(REGION_SIDE - 1).cast("long")
    return x.cast("long").bitwiseAND(side) + REGION_SIDE * z.cast("long").bitwiseAND(side)


def dimension_folder(dim: Column) -> Column:
    """The folder of a dimension below the world; other ids have to be namespace:path."""
    parts = F.split(dim, ":", 2)
    return (
        F.when(dim == "minecraft:overworld", "")
        .when(dim == "minecraft:the_nether", "DIM-1")
        .when(dim == "minecraft:the_end", "DIM1")
        .when(F.size(parts) == 2, F.concat_ws("/", F.lit("dimensions"), F.get(parts, 0), F.get(parts, 1)))
        .otherwise(F.raise_error(F.concat(F.lit("not a dimension id: "), dim)))
    )


def saved_data_target(key: Column) -> Column:
    """Where saved data goes: a path as it is, a bare name to the main dimension."""
    return F.when(F.instr(key, "/") > 0, key).otherwise(F.concat(F.lit("data/"), key, F.lit(".dat")))


def is_external(kind: Column) -> Column:
    """Whether a payload's type byte says that its bytes are in a file of their own."""
    return kind.bitwiseAND(F.lit(128)) != 0


def payload_kind(kind: Column) -> Column:
    return kind.bitwiseAND(F.lit(127))


def type_byte(payload: Column) -> Column:
    return F.conv(F.hex(F.substring(payload, 1, 1)), 16, 10).cast("int")


def area(x: Column, z: Column, radius: int) -> tuple[Column, Column]:
    """Generators of the (2r + 1) squared cells around a cell; explode one after the other."""
    if not 0 <= radius <= MAX_CELLS or (2 * radius + 1) ** 2 > MAX_CELLS:
        raise ValueError(f"an area has at most {MAX_CELLS} cells")
    return F.explode(F.sequence(x - radius, x + radius)), F.explode(F.sequence(z - radius, z + radius))


def area_check(x: Column, z: Column, radius: Column) -> Column:
    """What may be done with the area around a cell: its cells, whether an offline and an online restore take it, and whether the latter asks first.

    Nothing is allowed whose corners leave the range of 32-bit integers.
    """
    side = 2 * radius.cast("long") + 1
    low, high = F.lit(-(2**31)), F.lit(2**31 - 1)
    fits = (radius >= 0) & (F.least(x, z) - radius.cast("long") >= low) & (F.greatest(x, z) + radius.cast("long") <= high)
    return F.struct(
        (side * side).alias("cells"),
        (fits & (side * side <= MAX_CELLS)).alias("offline"),
        (fits & (radius <= MAX_RADIUS)).alias("online"),
        (side * side > CONFIRM_CELLS).alias("confirm"),
    )


def still_confirmed(asked_ms: Column, now_ms: Column) -> Column:
    """Whether an area that needs confirming was asked for no longer ago than a confirmation holds."""
    return now_ms - asked_ms <= CONFIRM_MS


def parse_pair(text: Column) -> Column:
    """'x,z' as a struct of integers; null where it is none."""
    parts = F.split(text, ",")
    x, z = F.get(parts, 0).try_cast("int"), F.get(parts, 1).try_cast("int")
    return F.when((F.size(parts) == 2) & x.isNotNull() & z.isNotNull(), F.struct(x.alias("x"), z.alias("z")))

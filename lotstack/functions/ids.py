"""Hierarchical 25-digit parcel codes as column expressions.

state 2, district 3, subdistrict 2, village 4, parcel 6, vertical 4, unit 4 digits. The parcel part is a hash of the
rounded coordinates; it has a million values, so codes can collide: `operators.constraints.duplicates` reports them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotstack.functions.binding import let

#: Digits of each part, and the default administrative codes.
WIDTHS = {"state": 2, "district": 3, "subdistrict": 2, "village": 4, "parcel": 6, "vertical": 4, "unit": 4}
DEFAULT_ADMIN = {"state": "01", "district": "001", "subdistrict": "01", "village": "0001"}
LENGTH = sum(WIDTHS.values())
#: The third coordinate of a parcel's hash is this constant: identifiers in use depend on it.
PARCEL_Z = 6.0


def pad(value: Column, digits: int) -> Column:
    """Left-padded with zeros after the sign, then the rightmost `digits` characters."""

    def padded(text: Column) -> Column:
        signed = text.startswith("-") | text.startswith("+")
        body = F.when(signed, F.substring(text, 2, 2**31 - 1)).otherwise(text)
        sign = F.when(signed, F.substring(text, 1, 1)).otherwise("")
        wanted = F.greatest(F.lit(digits), F.length(text)) - F.length(sign)
        return F.right(F.concat(sign, F.lpad(body, wanted, F.lit("0"))), F.lit(digits))

    return let(value.cast("string"), padded)


def compose(**parts: Column) -> Column:
    return F.concat(*(pad(parts[name], width) for name, width in WIDTHS.items()))


def parse(code: Column) -> Column:
    """A struct of the parts; all null, with is_valid false, unless the code has 25 characters."""
    valid = F.coalesce(F.length(code) == LENGTH, F.lit(False))
    fields, at = [], 1
    for name, width in WIDTHS.items():
        fields.append(F.when(valid, F.substring(code, at, width)).alias(name))
        at += width
    return F.struct(*fields, valid.alias("is_valid"))


def parse_strict(code: Column) -> Column:
    wrong = F.raise_error(F.concat(F.lit("a parcel code has 25 digits: "), F.coalesce(code, F.lit("null"))))
    return F.when(F.coalesce(F.length(code) == LENGTH, F.lit(False)), parse(code)).otherwise(wrong)


def hierarchy_path(code: Column) -> Column:
    """The codes of the parcel, of the floor, and the code itself."""
    base = F.substring(code, 1, 17)
    return F.array(F.concat(base, F.lit("00000000")), F.concat(base, F.substring(code, 18, 4), F.lit("0000")), code)


def double_bits(value: Column) -> Column:
    """The 64 bits of a normal double or zero, by arithmetic whose steps are all exact."""
    power = lambda e: F.pow(F.lit(2.0), e)

    def bits(v: Column) -> Column:
        size = F.abs(v)
        corrected = lambda e: F.when(size >= power(e + 1), e + 1).when(size < power(e), e - 1).otherwise(e)
        joined = lambda e: F.shiftleft(e + 1023, 52) + ((size / power(e) - 1) * float(2**52)).cast("long")
        plain = F.when(size == 0, F.lit(0).cast("long")).otherwise(let(let(F.floor(F.log2(size)), corrected), joined))
        return F.when(v < 0, plain.bitwiseOR(F.lit(-(2**63)))).otherwise(plain)

    return let(value, bits)


def _little_endian(value: Column) -> Column:
    return let(F.lpad(F.hex(double_bits(value)), 16, "0"), lambda d: F.concat(*(F.substring(d, k, 2) for k in range(15, 0, -2))))


def coordinate_hash(x: Column, y: Column, z: Column, digits: int = 6) -> Column:
    """The MD5 of three rounded doubles, as a number modulo 10**digits.

    Decimal ties at the fourth place are rounded from the shortest decimal text.
    """
    modulus = 10**digits

    def remainder(digest: Column) -> Column:
        number = F.lit(0).cast("long")
        for at in (1, 9, 17, 25):
            number = (number * (2**32 % modulus) + F.conv(F.substring(digest, at, 8), 16, 10).cast("long")) % modulus
        return F.lpad(number.cast("string"), digits, "0")

    return let(F.md5(F.unhex(F.concat(*(_little_endian(F.round(v.cast("double"), 3)) for v in (x, y, z))))), remainder)


def encode_vertical(floor: Column, sub: Column | None = None) -> Column:
    """Floors -100 to 899 as three digits, floor + 100, and one digit; null beyond."""
    sub = F.lit(0) if sub is None else sub
    return F.when(floor.between(-100, 899), F.concat(F.lpad((floor + 100).cast("string"), 3, "0"), sub.cast("string")))


def decode_vertical(vertical: Column) -> Column:
    return F.struct(
        (F.substring(vertical, 1, 3).cast("int") - 100).alias("floor"), F.substring(vertical, 4, 1).cast("int").alias("sub")
    )


def floor_level(code: Column) -> Column:
    return decode_vertical(parse(code)["vertical"])["floor"]


def _admin(admin: dict[str, Column] | None) -> dict[str, Column]:
    return {k: F.lit(v) for k, v in DEFAULT_ADMIN.items()} | (admin or {})


def parcel_code(x: Column, y: Column, admin: dict[str, Column] | None = None) -> Column:
    return compose(**_admin(admin), parcel=coordinate_hash(x, y, F.lit(PARCEL_Z)), vertical=F.lit("0000"), unit=F.lit("0000"))


def _with(code: Column, vertical: Column | None = None, unit: Column | None = None) -> Column:
    return F.concat(
        F.substring(code, 1, 17),
        F.substring(code, 18, 4) if vertical is None else pad(vertical, 4),
        F.substring(code, 22, 4) if unit is None else pad(unit, 4),
    )


def building_code(parcel: Column, building: Column) -> Column:
    return _with(parcel, vertical=building)


def floor_code(building: Column, floor: Column) -> Column:
    """The floor takes the building's place in the code: floors of one parcel's buildings share codes."""
    return _with(building, vertical=encode_vertical(floor))


def unit_code(floor: Column, unit: Column) -> Column:
    return _with(floor, unit=unit)


def code_for(level: Column, x: Column, y: Column, building: Column, floor: Column, unit: Column, admin: dict[str, Column] | None = None) -> Column:
    """The code at a level: parcel, building, floor or unit, of an administrative area if given; an unknown level is an error."""
    parcel = parcel_code(x, y, admin)
    on_floor = floor_code(building_code(parcel, building), floor)
    return (
        F.when(level == "parcel", parcel)
        .when(level == "building", building_code(parcel, building))
        .when(level == "floor", on_floor)
        .when(level == "unit", unit_code(on_floor, unit))
        .otherwise(F.raise_error(F.concat(F.lit("unknown level: "), level)))
    )


def manual_code(key: Column) -> Column:
    """A code for a unit entered by hand, from a supplied key: 24 characters, so it never parses as a parcel code."""
    return F.concat(F.lit("MANUAL"), F.lpad(F.pmod(key, F.lit(10**18)).cast("string"), 18, "0"))


def floor_from_z(z_base: Column, z_top: Column, ground: Column, storey: float = 3.0) -> Column:
    """The storey that holds the middle of a volume; ties go to the even storey."""
    return F.rint(((z_base + z_top) / 2 - ground) / storey).cast("int")


def register(spark) -> None:
    """The code functions for SQL: generate_parcel_id, parse_parcel_id and compute_floor_level."""
    widths = ", ".join(f"right(lpad({n}, greatest(length({n}), {w}), '0'), {w})" for n, w in WIDTHS.items())
    names = ", ".join(f"{n} STRING" for n in WIDTHS)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION generate_parcel_id({names}) RETURNS STRING RETURN concat({widths})")
    at, parts = 1, []
    for n, w in WIDTHS.items():
        parts.append(f"'{n}', substring(code, {at}, {w})")
        at += w
    fields = ", ".join(f"{n}: STRING" for n in WIDTHS)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION parse_parcel_id(code STRING) RETURNS STRUCT<{fields}> RETURN named_struct({', '.join(parts)})")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION compute_floor_level(z_base DOUBLE, z_top DOUBLE, ground DOUBLE) "
        "RETURNS INT RETURN cast(rint(((z_base + z_top) / 2 - ground) / 3.0D) AS INT)"
    )

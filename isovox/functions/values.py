"""Expressions over metadata values and voxels. All are built in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What C's strtod reads from the start of a text.
NUMBER = r"^[ \t\n\x0B\f\r]*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
#: Codes of elements whose explicit length takes four bytes.
LONG_FORM = ["OB", "OD", "OF", "OL", "OW", "SQ", "UC", "UN", "UR", "UT"]
#: All known two-letter codes.
CODES = "AE AS AT CS DA DS DT FD FL IS LO LT OB OD OF OL OW PN SH SL SQ SS ST TM UC UI UL UN UR US UT".split()


def trimmed(value: Column) -> Column:
    """The text of a binary value: no blank or NUL at its end; null if the value has no byte, "" if only blanks."""
    return F.when(F.length(value) == 0, None).otherwise(F.regexp_replace(F.decode(value, "ISO-8859-1"), r"[ \x00]+$", ""))


def prefix_double(text: Column) -> Column:
    """The number that a text begins with, or null."""
    return F.regexp_extract(text, NUMBER, 1).try_cast("double")


def first_double(text: Column) -> Column:
    """The number that the first of a value's parts, parted by backslashes, begins with."""
    return prefix_double(F.substring_index(text, "\\", 1))


def double_list(text: Column) -> Column:
    """All parts as numbers; a part that isn't one is 0, a missing or empty text an empty list."""
    parts = F.transform(F.split(text, r"\\", -1), lambda t: F.coalesce(prefix_double(t), F.lit(0.0)))
    return F.when(text.isNull() | (text == ""), F.array().cast("array<double>")).otherwise(parts)


def uint16(value: Column, big_endian: Column | bool = False) -> Column:
    """The first two bytes as an unsigned number, or null if there are fewer."""
    byte = lambda i: F.conv(F.hex(F.substring(value, i, 1)), 16, 10).cast("int")
    big = F.lit(big_endian) if isinstance(big_endian, bool) else big_endian
    return F.when(F.length(value) >= 2, F.when(big, byte(1) * 256 + byte(2)).otherwise(byte(2) * 256 + byte(1)))


def known_code(code: Column) -> Column:
    return F.when(code.isin(CODES), code).otherwise("??")


def long_form(code: Column) -> Column:
    return code.isin(LONG_FORM)


def modality(code: Column) -> Column:
    """CT, MR, XR (from CR, DX or XR) or UNKNOWN, in any case, untrimmed."""
    up = F.upper(code)
    return F.when(up.isin("CT", "MR"), up).when(up.isin("CR", "DX", "XR"), "XR").otherwise("UNKNOWN")


def hounsfield(pixel: Column, slope: Column, intercept: Column) -> Column:
    return pixel.cast("double") * slope + intercept


def linear_index(z: Column, y: Column, x: Column, width: Column, height: Column) -> Column:
    return (z.cast("bigint") * height + y) * width + x


def in_range(value: Column, low: float, high: float) -> Column:
    """Bounds count as 32-bit floats, both inclusive."""
    return (value >= F.lit(low).cast("float")) & (value <= F.lit(high).cast("float"))


def window_byte(value: Column, low: float = -1000.0, high: float = 1000.0) -> Column:
    """A value of the window as 0 to 255, half up."""
    if not high > low:
        raise ValueError("the window's end must be above its start")
    return F.floor(F.least(F.greatest((value.cast("double") - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("int")


def six_digits(value: Column) -> Column:
    """A double with six significant digits and no zeros at its end, as C++ streams print it.

    Digits are those of the number itself, a tie goes to the even one; Java's %e rounds its shortest text half up.
    """
    # Java takes ties of whole numbers up: those move by one, to the side of the even digit.
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(value))) - 5)
    tied = F.abs(value).between(1e6, 1e15) & (F.abs(value) % unit * 2 == unit)
    even = F.when(tied, value - F.signum(value) * F.when(F.floor(F.abs(value) / unit) % 2 == 0, 1).otherwise(-1)).otherwise(value)
    text = F.call_function("format_number", even, F.lit("0.00000E0"))
    exponent = F.regexp_extract(text, r"E(-?\d+)$", 1).cast("int")
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    mantissa = bare(F.regexp_extract(text, r"^(-?\d\.\d+)E", 1))
    scientific = F.concat(mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.when(F.abs(exponent) < 10, "0").otherwise(""), F.abs(exponent).cast("string"))
    fixed = bare(text.try_cast("decimal(38,12)").cast("string"))
    return F.when(value == 0, "0").when((exponent < -4) | (exponent >= 6), scientific).otherwise(fixed)


def json_text(text: Column) -> Column:
    """A JSON string: quotes, backslashes and control characters escaped, all else as it is."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code, short in ((10, "n"), (13, "r"), (9, "t")):
        out = F.replace(out, F.lit(chr(code)), F.lit("\\" + short))
    for code in (c for c in range(32) if c not in (9, 10, 13)):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), out, F.lit('"'))

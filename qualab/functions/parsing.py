"""Fixed parsing vocabularies: numeric patterns, boolean words, date formats and unit factors."""

from __future__ import annotations

# ----------------------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour; stated plainly, in natural order).
# ----------------------------------------------------------------------------------------

# strict number: what a numeric parser accepts (Spark's own cast also takes '12d', 'NaN')
STRICT_NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
# "forced" extraction patterns
FIRST_DIGITS = r"(\d+)"
FIRST_DECIMAL = r"([-+]?\d*\.\d+|\d+)"
# number + unit, and bare number, in unit text
NUMBER_WITH_UNIT = r"(-?\d+\.?\d*)\s*([a-zA-Z°]+)"
BARE_NUMBER = r"(-?\d+\.?\d*)"

TRUE_WORDS = ["true", "yes", "si", "verdadero", "y", "s", "t", "1"]
FALSE_WORDS = ["false", "no", "falso", "n", "f", "0"]

# candidate formats for date standardisation, in the order they are tried (strftime)
DATE_FORMATS = ["%d/%m/%Y", "%d-%m-%Y", "%Y-%m-%d", "%m/%d/%Y", "%d/%m/%y", "%Y/%m/%d", "%d.%m.%Y",
                "%d/%m/%Y %H:%M:%S", "%Y-%m-%d %H:%M:%S"]
# (prefix regex, format) pairs used by the second standardiser, in order
DATE_PATTERNS = [(r"\d{4}-\d{2}-\d{2}", "%Y-%m-%d"), (r"\d{2}/\d{2}/\d{4}", "%d/%m/%Y"),
                 (r"\d{4}/\d{2}/\d{2}", "%Y/%m/%d"), (r"\d{2}-\d{2}-\d{4}", "%d-%m-%Y"),
                 (r"\d{4}\.\d{2}\.\d{2}", "%Y.%m.%d")]
# target layouts by name
DATE_OUTPUTS = {"ISO": "%Y-%m-%d", "DMY": "%d/%m/%Y", "MDY": "%m/%d/%Y", "YMD": "%Y/%m/%d"}
# "possible date" prefixes (matched case-insensitively at the start of the text)
DATE_LIKE_PREFIXES = [
    r"\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}",
    r"\d{4}[/\-\.]\d{1,2}[/\-\.]\d{1,2}",
    r"\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{2,4}",
    r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{2,4}",
]
# whole-text formats also accepted as a possible date
DATE_LIKE_FORMATS = ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%Y/%m/%d", "%d-%m-%Y", "%m-%d-%Y", "%Y.%m.%d",
                     "%d.%m.%Y", "%d %b %Y", "%d %B %Y", "%b %d %Y", "%B %d %Y"]
# column-name words that mark a date column
DATE_NAME_WORDS = ["fecha", "date", "time", "hora", "day", "mes", "month", "año", "year"]

# text unit conversions: (from, to) → factor, or a formula for temperatures
UNIT_FACTORS = {
    # length
    ("mm", "cm"): 0.1, ("cm", "mm"): 10, ("cm", "m"): 0.01, ("m", "cm"): 100, ("m", "km"): 0.001,
    ("km", "m"): 1000, ("in", "cm"): 2.54, ("cm", "in"): 0.394, ("ft", "m"): 0.305, ("m", "ft"): 3.281,
    # mass
    ("mg", "g"): 0.001, ("g", "mg"): 1000, ("g", "kg"): 0.001, ("kg", "g"): 1000, ("lb", "kg"): 0.454,
    ("kg", "lb"): 2.205, ("oz", "g"): 28.35, ("g", "oz"): 0.035,
    # volume
    ("ml", "l"): 0.001, ("l", "ml"): 1000, ("l", "m3"): 0.001, ("m3", "l"): 1000, ("gal", "l"): 3.785,
    ("l", "gal"): 0.264,
    # temperature
    ("C", "F"): lambda x: x * 9 / 5 + 32, ("F", "C"): lambda x: (x - 32) * 5 / 9,
    ("C", "K"): lambda x: x + 273.15, ("K", "C"): lambda x: x - 273.15,
    # time
    ("s", "min"): 1 / 60, ("min", "s"): 60, ("min", "h"): 1 / 60, ("h", "min"): 60, ("h", "d"): 1 / 24,
    ("d", "h"): 24,
    # pressure
    ("Pa", "kPa"): 0.001, ("kPa", "Pa"): 1000, ("kPa", "MPa"): 0.001, ("MPa", "kPa"): 1000,
    ("bar", "kPa"): 100, ("kPa", "bar"): 0.01, ("psi", "kPa"): 6.895, ("kPa", "psi"): 0.145,
}

# numeric-column conversions by name (formulas over a Column)
NUMERIC_CONVERSIONS = {
    "celsius_a_fahrenheit": lambda x: x * 9 / 5 + 32,
    "fahrenheit_a_celsius": lambda x: (x - 32) * 5 / 9,
    "celsius_a_kelvin": lambda x: x + 273.15,
    "kelvin_a_celsius": lambda x: x - 273.15,
    "fahrenheit_a_kelvin": lambda x: (x - 32) * 5 / 9 + 273.15,
    "kelvin_a_fahrenheit": lambda x: (x - 273.15) * 9 / 5 + 32,
    "kilogramos_a_gramos": lambda x: x * 1000,
    "gramos_a_kilogramos": lambda x: x / 1000,
    "kilogramos_a_libras": lambda x: x * 2.20462,
    "libras_a_kilogramos": lambda x: x / 2.20462,
    "libras_a_onzas": lambda x: x * 16,
    "onzas_a_libras": lambda x: x / 16,
    "metros_a_centimetros": lambda x: x * 100,
    "centimetros_a_metros": lambda x: x / 100,
    "metros_a_pulgadas": lambda x: x * 39.3701,
    "pulgadas_a_metros": lambda x: x / 39.3701,
    "pulgadas_a_pies": lambda x: x / 12,
    "pies_a_pulgadas": lambda x: x * 12,
    "litros_a_mililitros": lambda x: x * 1000,
    "mililitros_a_litros": lambda x: x / 1000,
    "litros_a_galones": lambda x: x * 0.264172,
    "galones_a_litros": lambda x: x / 0.264172,
}
# name words that mark a temperature column, and the value ranges that decide its unit
TEMPERATURE_WORDS = ["temp", "temperatura", "temperature"]

# strftime directive → Java DateTimeFormatter pattern letters
STRFTIME_TO_JAVA = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss",
                    "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%p": "a", "%I": "hh"}
# lenient parse patterns: day/month accept one or two digits, as strptime does
STRFTIME_TO_JAVA_PARSE = dict(STRFTIME_TO_JAVA, **{"%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s"})


def java_pattern(fmt: str, parse: bool = False) -> str:
    """Translate a strftime format to a Java pattern (quoted literals kept)."""
    table = STRFTIME_TO_JAVA_PARSE if parse else STRFTIME_TO_JAVA
    out, i = [], 0
    while i < len(fmt):
        tok = fmt[i:i + 2]
        if tok in table:
            out.append(table[tok])
            i += 2
        elif tok == "%%":
            out.append("%")
            i += 2
        else:
            ch = fmt[i]
            out.append(f"'{ch}'" if ch.isalpha() else ("''" if ch == "'" else ch))
            i += 1
    return "".join(out)


def format_regex(fmt: str) -> str:
    """A cheap regex accepting every text the strftime ``fmt`` could parse (a superset):
    parsers are only tried on texts that pass it, which skips failing parses."""
    import re as _re
    out, i = ["^"], 0
    while i < len(fmt):
        tok = fmt[i:i + 2]
        if tok in ("%Y", "%y", "%m", "%d", "%H", "%M", "%S", "%I", "%j"):
            out.append(r"\d+")
            i += 2
        elif tok in ("%b", "%B", "%a", "%A", "%p"):
            out.append("[A-Za-z]+")
            i += 2
        elif tok == "%%":
            out.append("%")
            i += 2
        else:
            out.append(_re.escape(fmt[i]))
            i += 1
    out.append("$")
    return "".join(out)

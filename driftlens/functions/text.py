"""Text functions as Column expressions: normalising, lines, case folding, labels, record lines."""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space and as a line end in Unicode text.
WHITE = r"[\t-\r\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: As white space, with the zero-width non-joiner.
SPREAD = WHITE[:-2] + r"\u200c]+"
# Where a page tells its sheet.
SHEET = r"WORKING NUMBER\s*\n\s*([A-Z]{1,6}-[A-Z0-9]+)(?:\n|$)"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def normalize(text: Column) -> Column:
    """Zero-width non-joiners and no-break spaces become blanks, white space runs one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(text, SPREAD, " "))


def lines(text: Column) -> Column:
    """Normalised lines without blank ones."""
    return F.filter(F.transform(F.split(text, LINE_END), normalize), lambda x: x != "")


@lru_cache(maxsize=1)
def folding() -> tuple[str, str, dict[str, str], str]:
    """Unicode's full case folding: characters that fold to one character, what they fold to, those that fold to several,
    and a pattern of those that lower case doesn't fold (the sharp s and the sigmas apart)."""
    every = [*map(chr, range(0xD800)), *map(chr, range(0xE000, 0x110000))]
    pairs = [(c, c.casefold()) for c in every if c.casefold() != c]
    # From U+2C00 on are scripts that a Java of an older Unicode may not know.
    other = [ord(c) for c in every if (c.lower() != c.casefold() or (c.casefold() != c and ord(c) >= 0x2C00)) and c not in "ßςΣ"]
    runs = []
    for c in other:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    rare = r"(?=[^\x00-\x7f])[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs) + "]"
    return "".join(a for a, b in pairs if len(b) == 1), "".join(b for _, b in pairs if len(b) == 1), {a: b for a, b in pairs if len(b) > 1}, rare


def fold(text: Column) -> Column:
    """Unicode's full case folding: lower case with the sharp s and the sigmas folded, character by character only for texts with rarer cases."""
    one, to, several, rare = folding()
    low = F.replace(F.replace(F.lower(F.replace(text, F.lit("Σ"), F.lit("σ"))), F.lit("ς"), F.lit("σ")), F.lit("ß"), F.lit("ss"))
    to_several = F.from_json(F.lit(json.dumps(several)), "map<string,string>")  # one literal after folding; nested calls make plans slow to analyse
    spelt = F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(to_several, c), c))
    return F.when(text.rlike(rare), F.translate(F.array_join(spelt, ""), one, to)).otherwise(low)


def cut(text: Column, most: int, mark: str = "") -> Column:
    """The first ``most`` code points, with ``mark`` where something is left out."""
    return F.concat(F.left(text, F.lit(most)), F.when(F.length(text) > most, mark).otherwise(""))


def range_label(first: Column, last: Column) -> Column:
    """``a`` or ``a–b``; empty for an empty range."""
    return F.when(last < first, "").when(first == last, first.cast("string")).otherwise(F.concat_ws("–", first.cast("string"), last.cast("string")))


def sheet_label(page_text: Column) -> Column:
    return F.regexp_extract(page_text, SHEET, 1)


def record(line: Column) -> Column:
    """A pipe-delimited record line as struct(code, description, unit, category); null if it isn't one."""
    parts = F.transform(F.split(line, r"\|"), lambda x: F.trim(F.regexp_replace(x, rf"^{WHITE}|{WHITE}$", "")))
    ok = (F.size(parts) >= 5) & F.get(parts, F.lit(0)).rlike(r"^[\p{Nd}²³¹⁰-⁹]+$") & (F.get(parts, F.lit(1)) != "")
    rest = F.filter(F.slice(parts, 5, F.greatest(F.size(parts), F.lit(5))), lambda x: x != "")
    made = F.struct(F.get(parts, F.lit(1)).alias("code"), F.get(parts, F.lit(2)).alias("description"), F.get(parts, F.lit(3)).alias("unit"), F.array_join(rest, " | ").alias("category"))
    return F.when(ok, made)


def valid_email(address: Column) -> Column:
    """One ``@``, a dot after it, no white space (of Unicode) and no semicolon; nothing may follow, not even a line end."""
    part = "[^" + WHITE[1:-2] + ";@]+"
    return address.rlike(rf"\A{part}@{part}\.{part}\z")


def preview_id(path: Column, prefix: str = "preview-") -> Column:
    """A stable content id of an image path, the same as ``report.image_id``."""
    return F.concat(F.lit(prefix), F.left(F.sha2(path, 256), F.lit(20)))


def escape_html(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out

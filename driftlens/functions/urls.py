"""URL functions as Column expressions (RFC 3986, appendix B), without exceptions on odd input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
# What stays unencoded in paths and queries, beside letters, digits and ``_.-~``.
SAFE_PATH, SAFE_QUERY = "/%:@!$&'()*+,;=", "=&?/:;+,%@!$'()*"
# Document file suffixes and suffixes of content types.
DOCUMENT_SUFFIXES = (".pdf", ".doc", ".docx", ".docm", ".xls", ".xlsx", ".xlsm", ".txt", ".csv", ".zip", ".dgn", ".dwg")
TYPE_SUFFIX = {
    "application/pdf": ".pdf",
    "text/plain": ".txt",
    "text/csv": ".csv",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
    "application/vnd.ms-excel.sheet.macroenabled.12": ".xlsm",
}


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, PARTS, n)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


# User, then a bracketed address or a name, then a port.
NET = r"^(?:.*@)?(?:\[([^\]]*)\]|([^:@\[\]]*))(?::(\d*))?$"


def host_of(net: Column) -> Column:
    return F.lower(F.concat(F.regexp_extract(net, NET, 1), F.regexp_extract(net, NET, 2)))


def host(url: Column) -> Column:
    """Lower-case host without user, password, port and brackets."""
    return host_of(part(url, 2))


def path(url: Column) -> Column:
    return part(url, 3)


def quote(text: Column, safe: str) -> Column:
    """UTF-8 percent-encoding of all but letters, digits, ``_.-~`` and ``safe``.

    Form encoding writes every other character as an escape and a blank as ``+``; each escape begins with its own
    ``%``, so those of characters that stay are undone one by one, that of ``%`` itself last.
    """
    out = F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    for c in ["~", *sorted(safe, key=lambda c: c == "%")]:
        out = F.replace(out, F.lit("".join(f"%{b:02X}" for b in c.encode())), F.lit(c))
    return out


def unquote(text: Column) -> Column:
    """Percent-decoding; ``+`` and broken escapes stay as they are, broken UTF-8 becomes U+FFFD."""
    kept = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(kept), text)


def suffix(url: Column) -> Column:
    """Lower-case file suffix of the decoded path; names that begin with a dot have none."""
    return F.lower(F.regexp_extract(F.regexp_replace(unquote(path(url)), "/+$", ""), r"[^/](\.[^./]+)$", 1))


def file_name(url: Column) -> Column:
    return F.element_at(F.split(unquote(F.regexp_replace(path(url), "/+$", "")), "/"), -1)


def without_dots(segments: Column) -> Column:
    """A path of segments whose ``.`` and ``..`` are followed, at any depth; a last one leaves a folder."""
    last = F.element_at(segments, -1)
    rest = F.filter(segments, lambda x: x != ".")
    kept = F.aggregate(rest, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))))
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.regexp_replace(F.array_join(kept, "/"), "^/", ""))


def canonical(base: Column, link: Column) -> Column:
    """Resolved against ``base``; scheme and host lower-case, no user nor fragment, path and query encoded.

    Absolute and ``//host`` links keep their paths; of relative and root-relative ones dot segments are followed, and
    relative ones lose empty segments. A link with the base's own web scheme but no host is relative.
    """
    x = F.trim(link)
    b_scheme, b_net, b_path = part(base, 1), part(base, 2), part(base, 3)
    has_net = x.rlike(r"^(?:[^:/?#]+:)?//")
    own = F.lower(part(x, 1))
    own_scheme = F.when((own == F.lower(b_scheme)) & own.isin("http", "https", "ftp") & ~has_net, "").otherwise(own)
    own_path = part(x, 3)
    absolute = (own_scheme != "") | has_net
    folder = F.split(F.regexp_replace(b_path, r"[^/]+$", ""), "/")
    folder = F.slice(folder, 1, F.greatest(F.size(folder) - 1, F.lit(1)))
    below = F.concat(folder, F.split(own_path, "/"))
    inner = F.filter(F.slice(below, 2, F.greatest(F.size(below) - 2, F.lit(0))), lambda s: s != "")
    below = F.concat(F.slice(below, 1, 1), inner, F.slice(below, -1, 1))
    relative = F.when(own_path == "", b_path).when(own_path.startswith("/"), without_dots(F.split(own_path, "/"))).otherwise(without_dots(below))
    the_path = F.when(absolute, own_path).otherwise(relative)
    the_scheme = F.when(own_scheme != "", own_scheme).otherwise(F.lower(b_scheme))
    net = F.when(absolute, part(x, 2)).otherwise(b_net)
    query = F.when(x.rlike(r"^[^#]*\?") | absolute | (own_path != ""), part(x, 4)).otherwise(part(base, 4))
    port = F.regexp_replace(F.regexp_extract(net, NET, 3), r"^0+", "")
    place = F.concat(host_of(net), F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""))
    ask = quote(query, SAFE_QUERY)
    return F.concat(
        F.when(the_scheme != "", F.concat(the_scheme, F.lit(":"))).otherwise(""), F.when(net != "", F.concat(F.lit("//"), place)).otherwise(""),
        quote(the_path, SAFE_PATH), F.when(ask != "", F.concat(F.lit("?"), ask)).otherwise(""),
    )


# Where a content disposition tells a file name.
FILE_NAME = r"filename\*?=(?:UTF-8''|\")?([^\";]+)"


def disposition_name(disposition: Column) -> Column:
    """The first file name in a content disposition, plain or extended, up to a quote or semicolon; a UTF-8 mark before it is left out."""
    said = F.coalesce(disposition, F.lit(""))
    return F.trim(F.regexp_extract(said, f"(?i){FILE_NAME}", 1))


def infer_suffix(url: Column, content_type: Column, disposition: Column) -> Column:
    """A known suffix of the URL, else that of the disposition's file name, else by content type, else the URL's."""
    own = suffix(url)
    named = F.lower(F.regexp_extract(unquote(disposition_name(disposition)), r"[^/](\.[^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in TYPE_SUFFIX.items() for x in kv])
    return F.when(own.isin(*DOCUMENT_SUFFIXES), own).when(named != "", named).otherwise(F.coalesce(F.get(F.array(F.try_element_at(table, F.lower(F.coalesce(content_type, F.lit(""))))), F.lit(0)), own))

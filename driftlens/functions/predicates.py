"""Predicates over documents and changes, parameterised by lists instead of constants."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text, urls


@dataclass(frozen=True)
class Exclusions:
    """Top sections, exact files (folder, name) on given hosts, and path prefixes that are left out."""

    top_sections: tuple[str, ...] = ()
    file_folder: str = ""
    file_names: tuple[str, ...] = ()
    path_prefixes: tuple[str, ...] = ()
    hosts: tuple[str, ...] = ()


@dataclass(frozen=True)
class Filters:
    """All dimensions must match, one value of a dimension is enough, an empty dimension passes."""

    sections: tuple[str, ...] = field(default=())
    titles: tuple[str, ...] = field(default=())
    extensions: tuple[str, ...] = field(default=())


def is_document(url: Column, hosts: tuple[str, ...], folder: str = "/documents/") -> Column:
    return urls.host(url).isin(*hosts) & (F.lower(urls.path(url)).startswith(folder) | urls.suffix(url).isin(*urls.DOCUMENT_SUFFIXES))


def is_excluded(section: Column, url: Column, ex: Exclusions) -> Column:
    top = text.fold(F.get(F.split(F.coalesce(section, F.lit("")), " / "), F.lit(0)))
    where = F.replace(urls.unquote(urls.path(url)), F.lit("\\"), F.lit("/"))
    out = F.lit(False)
    if ex.top_sections:
        out |= top.isin(*[x.casefold() for x in ex.top_sections])
    if ex.file_names:
        out |= urls.host(url).isin(*ex.hosts) & where.isin(*[f"{ex.file_folder}{x}" for x in ex.file_names])
    for p in ex.path_prefixes:
        out |= text.fold(where).startswith(p.casefold())
    return out


def normal_filters(sections: Column, titles: Column, extensions: Column) -> tuple[Column, Column, Column]:
    tidy = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), text.normalize), lambda v: v != "")
    dotted = F.transform(F.filter(F.coalesce(extensions, F.array().cast("array<string>")), lambda v: F.trim(v) != ""), lambda v: F.lower(F.concat(F.lit("."), F.regexp_replace(v, r"^\.+", ""))))
    return tidy(sections), tidy(titles), dotted


def matches(section: Column, title: Column, url: Column, sections: Column, titles: Column, extensions: Column) -> Column:
    """Filters held in array columns, as in a table of routes."""
    s, t, e = normal_filters(sections, titles, extensions)
    own_s, own_t, own_e = text.fold(F.coalesce(section, F.lit(""))), text.fold(F.coalesce(title, F.lit(""))), urls.suffix(F.coalesce(url, F.lit("")))
    return (
        ((F.size(s) == 0) | F.exists(s, lambda v: F.contains(own_s, text.fold(v))))
        & ((F.size(t) == 0) | F.exists(t, lambda v: F.contains(own_t, text.fold(v))))
        & ((F.size(e) == 0) | F.array_contains(e, own_e))
    )


def matches_fixed(section: Column, title: Column, url: Column, f: Filters) -> Column:
    if f == Filters():  # nothing to test: no expression in the plan
        return F.lit(True)
    arrays = [F.array(*[F.lit(x) for x in v]).cast("array<string>") for v in (f.sections, f.titles, f.extensions)]
    return matches(section, title, url, *arrays)


def link_matches(section: Column, title: Column, f: Filters) -> Column:
    """Filters as they hold for page links: sections and titles only, whatever extensions are asked for."""
    return matches_fixed(section, title, F.lit(""), Filters(f.sections, f.titles))


def is_record_document(title: Column, url: Column, prefix: str = "sqs-daily-", folder: str = "/payitems/") -> Column:
    """Files of record lines, told by the start of the title or by the decoded path; nulls count as empty."""
    own = text.fold(urls.unquote(urls.path(F.coalesce(url, F.lit("")))))
    return text.fold(F.coalesce(title, F.lit(""))).startswith(prefix) | F.contains(own, F.lit(folder + prefix))

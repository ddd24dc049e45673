"""Configuration: recipients, filters and routes, with the operations on them."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .functions.predicates import Filters
from .sources.state import read_json, write_json

DIMENSIONS = ("sections", "titles", "extensions")
NEEDED = {"extra_documents": ("url", "title"), "dynamic_documents": ("source_url", "title", "match_host")}
ROUTE = "name string, recipients array<string>, sections array<string>, titles array<string>, extensions array<string>, include_page_text boolean"
EMAIL = re.compile(r"[^\s;@]+@[^\s;@]+\.[^\s;@]+")


def valid_email(address: str) -> bool:
    return EMAIL.fullmatch(address) is not None


@dataclass
class Route:
    name: str
    recipients: list[str]
    include_page_text: bool = False
    sections: list[str] = field(default_factory=list)
    titles: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=list)


@dataclass
class Config:
    page_url: str
    recipients: list[str] = field(default_factory=list)
    failure_recipient: str = ""
    sections: list[str] = field(default_factory=list)
    titles: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=list)
    routes: list[Route] = field(default_factory=list)
    retry_attempts: int = 3
    retry_delay_seconds: float = 5
    confirmation_delay_seconds: float = 120
    heartbeat_days: float = 7
    history_limit: int = 100
    #: Objects with url and title; objects with title, source_url, match_host and, if given, match_path.
    extra_documents: list[dict] = field(default_factory=list)
    dynamic_documents: list[dict] = field(default_factory=list)

    def validate(self) -> Config:
        if not self.page_url.startswith(("http://", "https://")):
            raise ValueError("page_url must be an http(s) address")
        for name in ("recipients", *DIMENSIONS, "routes", *NEEDED):
            if not isinstance(getattr(self, name), list):
                raise ValueError(f"{name} must be a list")
        for name, keys in NEEDED.items():
            if any(not isinstance(x, dict) or not all(x.get(k) for k in keys) for x in getattr(self, name)):
                raise ValueError(f"{name} must be objects with {', '.join(keys)}")
        for r in self.routes:
            if not r.name or any(not isinstance(getattr(r, k), list) for k in ("recipients", *DIMENSIONS)):
                raise ValueError("a route needs a name and lists of recipients and filters")
        if not isinstance(self.failure_recipient, str):
            raise ValueError("failure_recipient must be an address")
        for a in [*self.recipients, *([self.failure_recipient] if self.failure_recipient else []), *(a for r in self.routes for a in r.recipients)]:
            if not valid_email(a):
                raise ValueError(f"not an address: {a}")
        for name in ("retry_attempts", "retry_delay_seconds", "confirmation_delay_seconds", "heartbeat_days", "history_limit"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, (int, float)) or value < 0:
                raise ValueError(f"{name} must be a number that isn't negative")
        if self.retry_attempts < 1:
            raise ValueError("retry_attempts must be 1 or more")
        return self

    def add_recipient(self, address: str) -> None:
        if not valid_email(address):
            raise ValueError(f"not an address: {address}")
        if address.casefold() not in map(str.casefold, self.recipients):
            self.recipients.append(address)

    def remove_recipient(self, address: str) -> None:
        self.recipients = [a for a in self.recipients if a.casefold() != address.casefold()]

    def set_route(self, route: Route) -> None:
        self.remove_route(route.name)
        self.routes.append(route)

    def remove_route(self, name: str) -> None:
        self.routes = [r for r in self.routes if r.name.casefold() != name.casefold()]

    def set_failure_recipient(self, address: str) -> None:
        """An empty address takes it away."""
        if address and not valid_email(address):
            raise ValueError(f"not an address: {address}")
        self.failure_recipient = address

    def set_filter(self, dimension: str, values: list[str]) -> None:
        if dimension not in DIMENSIONS:
            raise ValueError(f"not a dimension: {dimension}")
        setattr(self, dimension, list(values))

    def clear_filters(self) -> None:
        for dimension in DIMENSIONS:
            setattr(self, dimension, [])

    def set_number(self, name: str, value: float) -> None:
        """heartbeat_days, confirmation_delay_seconds, retry_attempts, retry_delay_seconds or history_limit."""
        before = getattr(self, name)
        setattr(self, name, value)
        try:
            self.validate()
        except ValueError:
            setattr(self, name, before)
            raise

    def filters(self) -> Filters:
        return Filters(tuple(self.sections), tuple(self.titles), tuple(self.extensions))

    def route_rows(self, spark: SparkSession) -> DataFrame:
        rows = [(r.name, r.recipients, r.sections, r.titles, r.extensions, r.include_page_text) for r in self.routes]
        return spark.createDataFrame(rows, ROUTE)

    def extra_rows(self, spark: SparkSession) -> DataFrame | None:
        rows = [(x["url"], x["title"], x.get("section"), i) for i, x in enumerate(self.extra_documents)]
        return spark.createDataFrame(rows, "url string, title string, section string, pos bigint") if rows else None

    def rule_rows(self, spark: SparkSession) -> DataFrame | None:
        rows = [(x["title"], x["source_url"], x["match_host"], x.get("match_path"), x.get("section")) for x in self.dynamic_documents]
        return spark.createDataFrame(rows, "title string, source_url string, match_host string, match_path string, section string") if rows else None

    def save(self, spark: SparkSession, path: str) -> None:
        write_json(spark, path, self.validate().as_dict())

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Config:
        return cls.of(read_json(spark, path, {}) or {})

    def as_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def of(cls, raw: dict) -> Config:
        """From a JSON object: missing keys get their defaults, unknown ones are ignored."""
        known = {k: v for k, v in raw.items() if k in cls.__dataclass_fields__}
        known["routes"] = [r if isinstance(r, Route) else Route(**r) for r in known.get("routes", [])]
        return cls(**known).validate()

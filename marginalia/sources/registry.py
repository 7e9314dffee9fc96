"""Registered publication sources, read through a Python data source.

A source is a transport: a function that gives the records of one page of one day.  Days and pages are planned by the
reader; no transport is built in, as this package makes no network calls of its own.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass(frozen=True)
class SourceParam:
    name: str
    description: str = ""
    required: bool = False
    default: str | None = None
    secret: bool = False


@dataclass(frozen=True)
class SourceDescriptor:
    name: str
    display_name: str
    description: str = ""
    params: tuple[SourceParam, ...] = ()


#: (day, page token, options) -> (records as JSON text, next token or None)
Transport = Callable[[str, str | None, dict[str, str]], tuple[list[str], str | None]]

# The sources and their parameters.
BUILT_IN = (
    SourceDescriptor("pubmed", "PubMed", "Citations by publication day", (SourceParam("api_key", "for a higher rate", secret=True),)),
    SourceDescriptor("biorxiv", "bioRxiv", "Preprints by posting day"),
    SourceDescriptor("medrxiv", "medRxiv", "Preprints by posting day"),
    SourceDescriptor("openalex", "OpenAlex", "Works by publication day", (SourceParam("email", "contact", required=True),)),
)
_SOURCES: dict[str, tuple[SourceDescriptor, Transport | None]] = {d.name: (d, None) for d in BUILT_IN}


def register_source(descriptor: SourceDescriptor, transport: Transport | None) -> None:
    _SOURCES[descriptor.name] = (descriptor, transport)


def list_sources() -> list[SourceDescriptor]:
    return [d for d, _ in _SOURCES.values()]


def source_names() -> list[str]:
    return list(_SOURCES)


def get_source(name: str, known: dict | None = None) -> tuple[SourceDescriptor, Transport | None]:
    known = _SOURCES if known is None else known
    if name not in known:
        raise ValueError(f"unknown source {name!r}; known: {', '.join(sorted(known))}")
    return known[name]


def source_options(name: str, given: dict[str, str], known: dict | None = None) -> dict[str, str]:
    """Given options and defaults; a missing required one is an error before anything is read."""
    descriptor, _ = get_source(name, known)
    out = {p.name: p.default for p in descriptor.params if p.default is not None} | given
    missing = [p.name for p in descriptor.params if p.required and not out.get(p.name)]
    if missing:
        raise ValueError(f"source {name!r} needs {', '.join(missing)}")
    return out


class Day(InputPartition):
    def __init__(self, day: str):
        super().__init__(day)
        self.day = day


class PublicationReader(DataSourceReader):
    """One partition per day; a day's pages follow each other, as a cursor asks for."""

    def __init__(self, name: str, first: str, last: str, options: dict[str, str], transport: Transport):
        self.name, self.first, self.last, self.options, self.transport = name, first, last, options, transport

    def partitions(self) -> list[Day]:
        a, b = datetime.date.fromisoformat(self.first), datetime.date.fromisoformat(self.last)
        return [Day((a + datetime.timedelta(i)).isoformat()) for i in range((b - a).days + 1)]

    def read(self, partition: Day) -> Iterator[tuple]:
        token, seq = None, 0
        while True:
            records, token = self.transport(partition.day, token, self.options)
            for r in records:
                yield self.name, partition.day, seq, r if isinstance(r, str) else json.dumps(r)
                seq += 1
            if token is None:
                return


def publication_source() -> type[DataSource]:
    """``format("publications")`` for the sources registered so far: options source, first, last and those of the source.

    Spark plans a read in a process of its own, which gets the class by value.  So the class is made here, around the
    sources and their transports; register it again (``use``) after registering a source.
    """
    known = dict(_SOURCES)

    class PublicationSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "publications"

        def schema(self) -> str:
            return "source string, day string, seq long, json string"

        def reader(self, schema) -> PublicationReader:
            given = {k.lower(): v for k, v in self.options.items()}
            name, first, last = given.pop("source"), given.pop("first"), given.pop("last")
            options = source_options(name, given, known)
            transport = get_source(name, known)[1]
            if transport is None:
                raise ValueError(f"source {name!r} has no transport; register one")
            return PublicationReader(name, first, last, options, transport)

    return PublicationSource


def use(spark: SparkSession) -> None:
    """Makes the sources registered so far readable by ``spark.read.format("publications")``."""
    spark.dataSource.register(publication_source())

"""Features of paged services as a Spark data source: one reader for the three ways in which they number pages.

`spark.dataSource.register(PagedFeatures)`, then `spark.read.format("paged_features").options(url=..., style="esri").load()`.
The service is asked how many features there are; if it says so, pages are dealt to partitions and read side by side,
otherwise one partition reads until a page is short. A page is asked for again after a failure, each time later."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Parameters: features of a page, pages of a partition, tries of a page, seconds to the first of these and at most, seconds of a request, offset beyond which a service is taken to repeat itself.
PAGE, PAGES, TRIES, WAIT_S, MOST_WAIT_S, TIMEOUT_S, MOST_OFFSET = 2_000, 8, 5, 0.5, 30.0, 30.0, 500_000


def _socrata(options: dict, offset: int, size: int) -> dict:
    return {"$limit": size, "$offset": offset, "$order": options.get("order", ":id")} | ({"$where": options["where"]} if options.get("where") else {})


def _esri(options: dict, offset: int, size: int) -> dict:
    return {"where": options.get("where", "1=1"), "outFields": "*", "outSR": 4326, "f": "json", "resultOffset": offset, "resultRecordCount": size}


def _wfs(options: dict, offset: int, size: int) -> dict:
    asked = {"service": "WFS", "version": "2.0.0", "request": "GetFeature", "typeNames": options.get("layer", ""), "outputFormat": "application/json", "srsName": "EPSG:4326", "count": size, "startIndex": offset}
    return asked | ({"sortBy": options["order"]} if options.get("order") else {}) | ({"CQL_FILTER": options["where"]} if options.get("where") else {})


#: By style: the query of a page, that of the number of features, and where the answer has it.
STYLES = {
    "socrata": (_socrata, lambda o: {"$select": "count(*)"} | ({"$where": o["where"]} if o.get("where") else {}), lambda x: x[0]["count"]),
    "esri": (_esri, lambda o: {"where": o.get("where", "1=1"), "returnCountOnly": "true", "f": "json"}, lambda x: x["count"]),
    "wfs": (_wfs, lambda o: _wfs(o, 0, 1) | {"resultType": "hits"}, lambda x: x["numberMatched"]),
}


def _get(url: str, query: dict, tries: int) -> object:
    full = f"{url}{'&' if '?' in url else '?'}{urllib.parse.urlencode(query)}"
    for k in range(tries):
        try:
            with urllib.request.urlopen(full, timeout=TIMEOUT_S) as answer:
                return json.load(answer)
        except (OSError, ValueError):
            if k == tries - 1:
                raise
            time.sleep(min(MOST_WAIT_S, WAIT_S * 2**k))


def _feature(raw: dict) -> tuple[dict, str | None]:
    """Properties as texts and geometry as GeoJSON: of GeoJSON features, of rows with `attributes` and `paths`, of plain rows with `the_geom`."""
    if "attributes" in raw:
        properties, paths = raw["attributes"], (raw.get("geometry") or {}).get("paths")
        geometry = {"type": "MultiLineString", "coordinates": paths} if paths else raw.get("geometry")
    elif raw.get("type") == "Feature":
        properties, geometry = raw.get("properties") or {}, raw.get("geometry")
    else:
        properties, geometry = {k: v for k, v in raw.items() if k != "the_geom"}, raw.get("the_geom")
    texts = {k: v if isinstance(v, str) else json.dumps(v) for k, v in properties.items() if v is not None}
    return texts, json.dumps(geometry) if geometry else None


@dataclass
class Pages(InputPartition):
    """Pages by number, the last excluded; None: until one is short."""

    first: int
    last: int | None


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.size = options, int(options.get("size", PAGE))
        self.layers = [x for x in options.get("layers", "").split(",") if x] or [""]  # a service of several layers: read one after another within a page

    def _url(self, layer: str) -> str:
        return self.options["url"].replace("{layer}", layer)

    def partitions(self) -> list[Pages]:
        _, query, number = STYLES[self.options.get("style", "esri")]
        try:
            most = max(int(number(_get(self._url(layer), query(self.options), TRIES))) for layer in self.layers)
        except (OSError, ValueError, KeyError, IndexError, TypeError):
            return [Pages(0, None)]
        pages = -(-most // self.size)
        return [Pages(k, min(k + PAGES, pages)) for k in range(0, pages, PAGES)] or [Pages(0, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        page = STYLES[self.options.get("style", "esri")][0]
        for layer in self.layers:
            k = partition.first
            while partition.last is None or k < partition.last:
                offset = k * self.size
                if offset > int(self.options.get("most_offset", MOST_OFFSET)) and partition.last is None:
                    raise ValueError(f"no short page up to offset {offset}")
                answer = _get(self._url(layer), page(self.options, offset, self.size), TRIES)
                rows = answer if isinstance(answer, list) else answer.get("features", [])
                for i, raw in enumerate(rows):
                    yield (layer or None, offset + i, *_feature(raw))
                if len(rows) < self.size:
                    break
                k += 1


class PagedFeatures(DataSource):
    """(layer, position, properties, geometry) of all features of a service."""

    @classmethod
    def name(cls) -> str:
        return "paged_features"

    def schema(self) -> str:
        return "layer string, position long, properties map<string, string>, geometry string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))

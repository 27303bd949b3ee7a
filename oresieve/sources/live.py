"""A live search connector as a Python data source: one partition a term, pages until a short one, with waits and retries."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import constants as K

ATTEMPTS, TIMEOUT, NO_DATA = 3, 30, (404, 409, 451)


def wait_for(status: int, headers, attempt: int, now: float) -> float | None:
    """Seconds to wait before the next attempt, None if the answer is final: a used-up quota waits for its reset, failures back off."""
    if status == 403 and headers.get("X-RateLimit-Remaining") == "0":
        return max(float(headers.get("X-RateLimit-Reset", now)) - now + 2, 2)
    return 5.0 * 2**attempt if status >= 500 or status == 0 else None


def get_json(url: str, token: str | None = None, sleep=time.sleep, attempts: int = ATTEMPTS):
    """The decoded answer; None if there is no data or every attempt failed, waits for the quota included."""
    request = urllib.request.Request(url, headers={"Accept": "application/json", **({"Authorization": f"Bearer {token}"} if token else {})})
    for attempt in range(attempts):
        status, headers = 0, {}
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as error:
            status, headers = error.code, error.headers
        except OSError:
            pass
        if status in NO_DATA:
            return None
        seconds = wait_for(status, headers, attempt, time.time())
        if seconds is None:
            raise OSError(f"status {status} from {url}")
        sleep(seconds)
    return None


def env_file(path: str) -> dict[str, str]:
    """The settings of a file of NAME=value lines; comments and blank lines are none, quotes around a value go. A missing file has none."""
    found = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as lines:
            for line in lines:
                name, equals, value = line.strip().removeprefix("export ").partition("=")
                if equals and not name.startswith("#"):
                    value = value.strip()
                    quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
                    found[name.strip()] = value[1:-1] if quoted else value
    return found


def secret(name: str, path: str | None = None) -> str | None:
    """A secret from the environment, or else from a file of settings; it is never an option or a column, as plans store these."""
    return os.environ.get(name) or (env_file(path).get(name) if path else None)


class Term(InputPartition):
    def __init__(self, seq: int, text: str):
        super().__init__(seq)
        self.seq, self.text = seq, text


class SearchReader(DataSourceReader):
    def __init__(self, options):
        self.base = options.get("url", "https://api.github.com/search/repositories")
        self.terms = json.loads(options["terms"])
        self.pages, self.rows = int(options.get("pages", K.MOST_PAGES)), int(options.get("rows", K.PAGE_ROWS))
        self.pause, self.token_name = float(options.get("pause", "1")), options.get("tokenvariable", "GITHUB_TOKEN")
        self.settings = options.get("settings")

    def partitions(self):
        return [Term(k, t) for k, t in enumerate(self.terms)]

    def read(self, partition):
        token = secret(self.token_name, self.settings)
        for page in range(1, self.pages + 1):
            query = urllib.parse.urlencode({"q": partition.text, "sort": "stars", "order": "desc", "per_page": self.rows, "page": page})
            items = (get_json(f"{self.base}?{query}", token) or {}).get("items", [])
            for pos, item in enumerate(items):
                yield partition.text, partition.seq, page, pos, json.dumps(item)
            if len(items) < self.rows:
                return
            time.sleep(self.pause)


class RepositorySearch(DataSource):
    """spark.read.format("repository_search").option("terms", json list): (term, term_seq, page, pos, item as JSON text)."""

    @classmethod
    def name(cls):
        return "repository_search"

    def schema(self):
        return "term string, term_seq int, page int, pos int, item string"

    def reader(self, schema):
        return SearchReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RepositorySearch)

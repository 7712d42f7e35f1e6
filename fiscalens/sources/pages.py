"""A paged source as a Spark data source: windows (days, months, agencies) of pages, over HTTP or as they were recorded in a folder.

    spark.dataSource.register(PageSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.read.format("pages").option("path", "/landing/pncp").load()
    spark.readStream.format("pages").option("path", "https://host/contracts?day={window}&page={page}").option("from", "2024-01-01").load()

A window's pages are numbered from ``first_page`` (1) without gaps; it ends at an absent or empty page, or at one that says that none is
left. How many there are need not be known: a window falls into ``stripes`` (4), of which each has every so many pages up to the first
empty one, and the stripes of all windows are dealt to ``tasks`` (64) at most. Rows are the records as JSON with window, page and item (place in the page).
"""

from __future__ import annotations

import datetime
import json
import time
import urllib.error
import urllib.request
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

SCHEMA = "window string, page int, item int, record string"
#: Where a page's records stand, if it is not a list itself, and what tells how many pages are left.
RECORDS, LEFT = ("data", "resultado", "items", "gazettes"), "paginasRestantes"
#: How a recorded page's file may end: plain first, as a page that is recorded by hand stands before one that record_pages() packed. And how
#: much that one is packed.
ENDINGS, PACKED, LEVEL = (".json", ".json.zst"), ".json.zst", 6
#: Files that are moved at once.
MOVERS = 16
#: Answers after which a request is made again.
AGAIN = {408, 425, 429, 500, 502, 503, 504}


def is_http(path: str) -> bool:
    return path.startswith(("http://", "https://"))


def folder(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def fetch(path: str, window: str, page: int, retries: int = 5, wait: float = 1.0, headers: dict[str, str] | None = None) -> bytes | None:
    """A page's bytes; None for a page that is not there. What a server refuses for the moment is asked for again, after longer and longer
    waits; any other failure raises, so that Spark runs the task again and no page is taken for an empty one."""
    if not is_http(path):
        fs, root = folder(path)
        for ending in ENDINGS:
            try:
                with fs.open_input_stream(f"{root}/{window}/{page}{ending}") as f:  # unpacked as its ending says
                    return f.read()
            except FileNotFoundError:
                pass
        return None
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(path.format(window=window, page=page), headers=headers or {}), timeout=60) as answer:  # noqa: S310
                return None if answer.status == 204 else answer.read()
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            if e.code not in AGAIN or attempt == retries:
                raise
        except (urllib.error.URLError, TimeoutError):
            if attempt == retries:
                raise
        time.sleep(wait * 2**attempt)
    return None


def records_of(body: bytes | None) -> tuple[list[str], bool]:
    """(a page's records as JSON, whether no page follows)."""
    if not body or not body.strip():
        return [], True
    found, last = json.loads(body), False
    if isinstance(found, dict):
        last = found.get(LEFT) == 0
        found = next((found[k] for k in RECORDS if isinstance(found.get(k), list)), [])
    return [json.dumps(r, ensure_ascii=False) for r in found], last or not found


class Stretch(NamedTuple):
    """Pages first, first + step, ... of a window, before ``end`` if it is given."""

    window: str
    first: int
    step: int = 1
    end: int | None = None


class Share(InputPartition):
    """What one task reads."""

    def __init__(self, stretches: list[Stretch]):
        self.stretches = stretches


class Offset(NamedTuple):
    """All windows before this one are read, and its pages before this number."""

    window: str
    page: int


def _batch(window: str, page: int, records: list[str]) -> pa.RecordBatch:
    n = len(records)
    return pa.record_batch([pa.array([window] * n), pa.array([page] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(records, pa.string())], names=["window", "page", "item", "record"])


class _Pages:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.first = int(options.get("first_page", 1))
        self.stripes, self.tasks = int(options.get("stripes", 4)), int(options.get("tasks", 64))
        self.retries, self.wait = int(options.get("retries", 5)), float(options.get("wait", 1.0))
        self.headers = json.loads(options.get("headers", "{}"))
        self.listed = [w for w in options.get("windows", "").split(",") if w]
        self.from_, self.to = options.get("from"), options.get("to")
        self.after = Offset(*json.loads(options["after"])) if "after" in options else None

    def windows(self) -> list[str]:
        """The windows asked for, in order: those listed, the days from ``from`` to ``to`` (today), or a folder's."""
        if self.listed:
            return sorted(self.listed)
        if is_http(self.path) and self.from_:
            day, last = datetime.date.fromisoformat(self.from_), datetime.date.fromisoformat(self.to) if self.to else datetime.date.today()
            return [(day + datetime.timedelta(k)).isoformat() for k in range((last - day).days + 1)]
        if is_http(self.path):
            return ["all"]
        fs, root = folder(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return sorted(x.base_name for x in found if x.type == pafs.FileType.Directory and (self.from_ or "") <= x.base_name <= (self.to or "\U0010ffff"))

    def there(self, window: str, page: int) -> bool:
        if not is_http(self.path):
            fs, root = folder(self.path)
            if not any(x.type == pafs.FileType.File for x in fs.get_file_info([f"{root}/{window}/{page}{ending}" for ending in ENDINGS])):
                return False
        return bool(records_of(fetch(self.path, window, page, self.retries, self.wait, self.headers))[0])

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        for s in partition.stretches if isinstance(partition, Share) else []:  # Spark makes one of its own of no partitions
            page = s.first
            while s.end is None or page < s.end:
                records, last = records_of(fetch(self.path, s.window, page, self.retries, self.wait, self.headers))
                if records:
                    yield _batch(s.window, page, records)
                if last:
                    break
                page += s.step

    def dealt(self, stretches: list[Stretch]) -> list[Share]:
        n = min(self.tasks, len(stretches))
        return [Share(stretches[k::n]) for k in range(n)]

    def stretches(self, window: str, first: int) -> list[Stretch]:
        return [Stretch(window, first + k, self.stripes) for k in range(self.stripes)]


class PageReader(_Pages, DataSourceReader):
    """Reads all windows, or those that filters on ``window`` leave, or what follows the offset ``after`` (JSON [window, page])."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        self.only: set[str] | None = None
        for f in filters:
            if isinstance(f, EqualTo | In) and tuple(f.attribute) == ("window",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = wanted if self.only is None else self.only & wanted
            else:
                yield f

    def partitions(self) -> list[Share]:
        only, after = getattr(self, "only", None), self.after or Offset("", self.first)
        return self.dealt([s for w in self.windows() if w >= after.window and (only is None or w in only) for s in self.stretches(w, after.page if w == after.window else self.first)])


class PageStreamReader(_Pages, DataSourceStreamReader):
    """Windows in their order. The last window that has pages is open: pages that come to it later are read later; it closes when a later one
    has pages."""

    def initialOffset(self) -> dict:  # noqa: N802
        return Offset(*(self.after or ("", self.first)))._asdict()

    def latestOffset(self) -> dict:  # noqa: N802
        floor = getattr(self, "seen", Offset(**self.initialOffset()))
        for window in reversed([w for w in self.windows() if w >= floor.window]):
            low = floor.page if window == floor.window else self.first
            if not self.there(window, low):
                if window == floor.window:
                    break
                continue
            step = 1
            while self.there(window, low + step):
                step *= 2
            known, absent = low + step // 2, low + step
            while absent - known > 1:
                middle = (known + absent) // 2
                known, absent = (middle, absent) if self.there(window, middle) else (known, middle)
            floor = Offset(window, absent)
            break
        self.seen = floor
        return floor._asdict()

    def partitions(self, start: dict, end: dict) -> list[Share]:
        a, b = Offset(**start), Offset(**end)
        out: list[Stretch] = []
        for w in self.windows():
            first = a.page if w == a.window else self.first
            if a.window <= w < b.window:
                out += self.stretches(w, first)
            elif w == b.window and first < b.page:
                out += [Stretch(w, first + k, self.stripes, b.page) for k in range(min(self.stripes, b.page - first))]
        return self.dealt(out)


class _Written(WriterCommitMessage):
    """The pages that a task has written: their windows and where they lie until they have numbers."""

    def __init__(self, pages: list[tuple[str, str]]):
        self.pages = pages


class PageWriter(DataSourceArrowWriter):
    """Records pages of ``per_page`` records at most: rows of one window must stand one behind the other in a task. Each task makes pages of
    its own, packed, aside; when all have ended, those of the tasks that count are numbered through by window and moved in place as a
    whole, so that no row moves for the numbers."""

    def __init__(self, options: dict[str, str]):
        self.path, self.per_page, self.first = options["path"], int(options.get("per_page", 500)), int(options.get("first_page", 1))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = folder(self.path)
        codec, own = pa.Codec("zstd", compression_level=LEVEL), uuid.uuid4().hex
        pages: list[tuple[str, str]] = []
        held: list[str] = []
        at: str | None = None

        def put() -> None:
            if held:
                fs.create_dir(f"{root}/{at}", recursive=True)
                pages.append((at, f"{root}/{at}/_{own}-{len(pages)}"))
                with fs.open_output_stream(pages[-1][1]) as f:
                    f.write(codec.compress(f'{{"data":[{",".join(held)}]}}'.encode(), asbytes=True))
                held.clear()

        for batch in iterator:
            for window, record in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("window", "record")), strict=True):
                if window != at or len(held) == self.per_page:
                    put()
                    at = window
                held.append(record)
        put()
        return _Written(pages)

    def commit(self, messages: list) -> None:
        fs, root = folder(self.path)
        number: Counter[str] = Counter()
        moves = []
        for message in messages:
            for window, aside in message.pages:
                moves.append((aside, f"{root}/{window}/{self.first + number[window]}{PACKED}"))
                number[window] += 1
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda x: fs.move(*x), moves))

    def abort(self, messages: list) -> None:
        fs, _ = folder(self.path)
        for message in messages:
            for _, aside in message.pages if message else []:
                fs.delete_file(aside)


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> PageStreamReader:  # noqa: N802
        return PageStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return PageWriter(self.options)


def pages(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(PageSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else Spark refuses a reader that takes filters
    return spark.read.format("pages").options(path=path, **options).load()


def page_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(PageSource)
    return spark.readStream.format("pages").options(path=path, **options).load()


def parsed(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select(F.from_json("record", schema).alias("_r")).select("_r.*")


def record_pages(df: DataFrame, path: str, window: str, per_page: int = 500, first_page: int = 1) -> None:
    """df's rows, without ``window``, as recorded pages of ``per_page`` records at most by the values of ``window``.

    Rows stay in their tasks, of which each makes pages of its own; pages are packed and numbered through by window, so that the work has
    no exchange beyond what df has itself.
    """
    record = F.to_json(F.struct(*[c for c in df.columns if c != window]))
    rows = df.select(F.col(window).cast("string").alias("window"), record.alias("record")).sortWithinPartitions("window")
    df.sparkSession.dataSource.register(PageSource)
    rows.write.format("pages").mode("append").option("path", path).option("per_page", per_page).option("first_page", first_page).save()

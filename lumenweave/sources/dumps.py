"""Crawl dumps read and written by many tasks, however large one of them is.

Reading: a dump is one JSON object, whose pages are an array in it. Spark's text source splits it behind closing braces, so a task begins anywhere: within
a string, a page or a list. Chunks of bounded size are therefore scanned twice. The first scan counts a chunk's quotes, and its brackets under both
assumptions (it begins inside or outside a string); sums of these over the chunks before tell where each chunk begins, in or out of a string and how deep. The
second cuts it at the commas of the second level into pieces. Only pieces that cross an edge are put together again by a shuffle. All files are read by Spark.

Writing: ``crawl_files`` is a data source that writes one file a name. Tasks write to a staging folder, and the commit moves the files of the tasks that
succeeded to their places; a failed job leaves none.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .crawl import CRAWL_DIAGNOSTICS, CRAWL_STATS, PAGE, Crawl, complete_pages, raw_counts
from .tables import written

CHUNK = 4 << 20
HEAD = ("seed_url", "crawled_at", "crawl_stats", "crawl_diagnostics", "raw_scrapy_stats")
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]], _STEP[[ord("}"), ord("]")]] = 1, -1
_MARK = np.zeros(256, bool)
_MARK[list(b"{}[],:")] = True


# --- reading -----------------------------------------------------------------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch], limit: int):
    """(file, start, number, bytes) of a task's rows (file, start, value): consecutive records of one split, each with the brace that ended it."""
    key, parts, size, number = None, [], 0, 0
    for batch in batches:
        for file, start, value in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if (file, start) != key or size >= limit:
                if parts:
                    yield *key, number, b"".join(parts)
                number = number + 1 if (file, start) == key else 0
                key, parts, size = (file, start), [], 0
            parts += [value.encode("utf-8", "surrogatepass"), b"}"]
            size += len(parts[-2]) + 1
    if parts:
        yield *key, number, b"".join(parts)


def _marks(data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of ``{}[],:``, whether an odd number of quotes stands before each, and the parity of all quotes. A quote behind an odd run of backslashes is none."""
    b = np.frombuffer(data, np.uint8)
    q = b == 34
    slash = b == 92
    if slash.any():
        at = np.flatnonzero(q)
        last = np.maximum.accumulate(np.where(slash, -1, np.arange(len(b))))
        run = at - 1 - np.where(at > 0, last[np.maximum(at - 1, 0)], -1)
        q[at[run % 2 == 1]] = False
    place = np.flatnonzero(_MARK[b])
    odd = np.cumsum(q, dtype=np.int64) & 1
    return place, odd[place].astype(bool), int(odd[-1]) if len(odd) else 0


def _sums(data: bytes) -> tuple[int, int, int]:
    """Parity of quotes, and how much deeper the chunk ends than it begins if it begins outside or inside a string."""
    place, odd, quotes = _marks(data)
    step = _STEP[np.frombuffer(data, np.uint8)[place]].astype(np.int64)
    return quotes, int(step[~odd].sum()), int(step[odd].sum())


def _pieces(data: bytes, inside: bool, depth: int):
    """(key, continued, open, text) of a chunk's pieces. key is None before the first key of the chunk; continued: it began in an earlier chunk; open: it goes on in a later one."""
    place, odd, _ = _marks(data)
    place = place[odd == inside]
    char = np.frombuffer(data, np.uint8)[place]
    after = depth + np.cumsum(_STEP[char].astype(np.int64))
    comma, colon = char == ord(","), char == ord(":")
    on = (comma & (after <= 2)) | (colon & (after == 1)) | ((char == ord("[")) & (after == 2)) | ((char == ord("]")) & (after == 1)) | ((char == ord("{")) & (after == 1)) | ((char == ord("}")) & (after == 0))
    key, begin, collecting, continued, mark = None, 0, depth >= 1, depth >= 1, 0
    out = []

    def emit(end: int, open_end: bool = False) -> None:
        nonlocal continued
        out.append((key, continued, open_end, data[begin:end]))
        continued = False

    for p, c, d in zip(place[on].tolist(), char[on].tolist(), after[on].tolist()):
        if c == ord(":"):
            key, begin, collecting = json.loads(data[mark:p]), p + 1, True
        elif c == ord("{"):
            mark = p + 1
        elif c == ord("["):
            begin = p + 1
        elif c == ord(",") and d == 2:
            emit(p)
            begin = p + 1
        else:  # the end of a value
            if collecting:
                emit(p)
            collecting, mark = False, p + 1
            if d == 0:
                return out
    if collecting and (depth >= 1 or len(place)):
        emit(len(data), True)
    return out


def pieces(spark: SparkSession, path: str, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(file, key, start, number, i, text): the top level of each dump. A value's parts between the commas of its second level come one a row, in order of (start, number, i), without a list's brackets. And (file) of all dumps."""
    text = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")

    def scanned(batches):
        for file, start, number, data in _chunks(batches, chunk):
            quotes, outside, inside = _sums(data)
            yield pa.RecordBatch.from_pylist([{"file": file, "start": start, "number": number, "data": data, "quotes": quotes, "outside": outside, "inside": inside}])

    key = ["file", "start", "number"]
    chunks = written(text.mapInArrow(scanned, "file string, start bigint, number bigint, data binary, quotes bigint, outside bigint, inside bigint"))
    before = Window.partitionBy("file").orderBy("start", "number").rowsBetween(Window.unboundedPreceding, -1)
    states = chunks.drop("data").withColumn("within", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    states = states.withColumn("depth", F.coalesce(F.sum(F.when(F.col("within"), F.col("inside")).otherwise(F.col("outside"))).over(before), F.lit(0)))

    def cut(batches):
        for batch in batches:
            for r in batch.to_pylist():
                got = _pieces(r["data"], r["within"], r["depth"])
                yield pa.RecordBatch.from_pylist([{**{k: r[k] for k in key}, "i": i, "key": k, "continued": c, "open": o, "text": t.decode("utf-8", "surrogatepass")} for i, (k, c, o, t) in enumerate(got)], _PIECE)

    found = chunks.select(*key, "data").join(states.select(*key, "within", "depth"), key).mapInArrow(cut, "file string, start bigint, number bigint, i bigint, key string, continued boolean, open boolean, text string")
    found = written(found)
    # a chunk's first pieces may belong to the last key, and its first one to the last piece, of chunks before it
    own = F.when(~F.col("continued"), F.struct("start", "number", "i"))
    last = found.groupBy(*key).agg(F.max_by("key", F.when(F.col("key").isNotNull(), F.col("i"))).alias("last_key"), F.max(own).alias("last_piece"))
    last = last.select(*key, F.last("last_key", True).over(before).alias("last_key"), F.last("last_piece", True).over(before).alias("last_piece"))
    found = found.join(last, key).withColumn("key", F.coalesce("key", "last_key"))
    whole = found.where("not continued and not open").select("file", "key", "start", "number", "i", "text")
    parts = found.where("continued or open").withColumn("of", F.when(F.col("continued"), F.col("last_piece")).otherwise(F.struct("start", "number", "i")))
    joined = parts.groupBy("file", "key", "of").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "number", "i", "text"))), lambda x: x["text"]), "").alias("text"))
    return whole.union(joined.select("file", "key", "of.start", "of.number", "of.i", "text")), chunks.select("file").distinct()


_PIECE = pa.schema([("file", pa.string()), ("start", pa.int64()), ("number", pa.int64()), ("i", pa.int64()), ("key", pa.string()), ("continued", pa.bool_()), ("open", pa.bool_()), ("text", pa.string())])


def _numbered(rows: DataFrame) -> DataFrame:
    """(file, seq, text) of a list's elements, numbered from 0: counts of the chunks before, and places within a chunk, which is bounded."""
    rows = written(rows.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    n = rows.groupBy("file", "start", "number").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("start", "number").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select("file", "start", "number", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("file", "start", "number").orderBy("i"))
    return rows.withColumn("nth", nth).join(n, ["file", "start", "number"]).select("file", (F.col("base") + F.col("nth") - 1).cast("bigint").alias("seq"), "text")


def load_dumps(spark: SparkSession, path: str, chunk: int = CHUNK) -> Crawl:
    """As ``load_json``, with every dump read by as many tasks as it has splits; objects that are kept as text (JSON-LD) come without spaces between their parts. Keys that a dump should not have are ignored; broken JSON fails; of a key that comes twice the parts are put together."""
    every, files = pieces(spark, path, chunk)
    every = written(every)
    strict = {"mode": "FAILFAST"}
    head = f"struct<seed_url: string, crawled_at: string, crawl_stats: {CRAWL_STATS}, crawl_diagnostics: {CRAWL_DIAGNOSTICS}, raw_scrapy_stats: map<string, string>>"
    rest = every.where(F.col("key").isin(*HEAD)).groupBy("file", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "number", "i", "text"))), lambda x: x["text"]), ",").alias("value"))
    rest = rest.groupBy("file").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(F.concat(F.lit('"'), "key", F.lit('":'), "value")), ","), F.lit("}")).alias("text"))
    rest = files.join(rest, "file", "left").select(F.col("file").alias("crawl_id"), F.from_json(F.coalesce("text", F.lit("{}")), head, strict).alias("x"))
    stats = F.col("x.raw_scrapy_stats")
    crawl = rest.select("crawl_id", "x.seed_url", "x.crawled_at", "x.crawl_stats", "x.crawl_diagnostics", F.try_element_at(stats, F.lit("finish_reason")).alias("finish_reason"), *raw_counts(stats))
    pages = _numbered(every.where("key = 'pages'")).select(F.col("file").alias("crawl_id"), F.col("seq").alias("page_seq"), F.from_json("text", PAGE, strict).alias("p")).select("crawl_id", "page_seq", "p.*")
    for c in ("url", "final_url", "status_code", "content_type", "depth"):
        pages = pages.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a page lacks {c}"))).otherwise(F.col(c)))
    wrapped = F.concat(F.lit('{"u":'), "text", F.lit("}"))
    object_ = F.trim(F.regexp_replace("text", r"\s+", " ")).startswith("{")
    unfetched = _numbered(every.where("key = 'unfetched_urls'")).select(F.col("file").alias("crawl_id"), "seq", F.when(object_, F.get_json_object(wrapped, "$.u.url")).otherwise(F.get_json_object(wrapped, "$.u")).alias("url"), F.when(object_, F.get_json_object(wrapped, "$.u.reason")).alias("reason"))
    return Crawl(written(crawl), written(complete_pages(pages)), written(unfetched))


# --- writing -----------------------------------------------------------------------------------------------


def dump_pieces(c: Crawl) -> DataFrame:
    """(name, seq, text): the pieces of each crawl's dump, to be put behind one another."""
    first = c.pages.groupBy("crawl_id").agg(F.min("page_seq").alias("first"))
    refused = c.unfetched.groupBy("crawl_id").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    keep = {"ignoreNullFields": "false"}
    head = F.struct("seed_url", "crawled_at", "crawl_stats", "crawl_diagnostics", F.create_map(F.lit("finish_reason"), F.col("finish_reason")).alias("raw_scrapy_stats"))
    start = c.crawl.select("crawl_id", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("n"), F.concat(F.regexp_replace(F.to_json(head, keep), r"\}$", ""), F.lit(',"pages":[')).alias("text"))
    page = F.struct(*[c_ for c_ in c.pages.columns if c_ not in ("crawl_id", "page_seq")])
    comma = F.when(F.col("first") == F.col("order"), F.lit("\n")).otherwise(F.lit(",\n"))
    pages = c.pages.withColumn("order", F.col("page_seq")).join(first, "crawl_id").select("crawl_id", F.lit(1).alias("part"), F.col("order").alias("n"), F.concat(comma, F.to_json(page, keep)).alias("text"))
    between = c.crawl.select("crawl_id", F.lit(2).alias("part"), F.lit(0).cast("bigint").alias("n"), F.lit('],"unfetched_urls":[').alias("text"))
    lost = c.unfetched.withColumn("order", F.col("seq")).join(refused, "crawl_id").select("crawl_id", F.lit(3).alias("part"), F.col("order").alias("n"), F.concat(comma, F.to_json(F.struct("url", "reason"), keep)).alias("text"))
    end = c.crawl.select("crawl_id", F.lit(4).alias("part"), F.lit(0).cast("bigint").alias("n"), F.lit("]}\n").alias("text"))
    every = start.union(pages).union(between).union(lost).union(end)
    return every.select(F.concat(quoted(F.col("crawl_id")), F.lit(".json")).alias("name"), F.struct("part", "n").alias("seq"), "text")


def quoted(name: Column) -> Column:
    """A crawl's name as one of a file."""
    return F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))


def write_files(rows: DataFrame, path: str) -> None:
    """Files of rows (name, seq, text): each name's texts in order of seq. A name's rows pass through one task, which writes them as they come."""
    rows.sparkSession.dataSource.register(CrawlFiles)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(parts, "name").sortWithinPartitions("name", "seq").select("name", "text").write.format(CrawlFiles.name()).mode("append").option("path", path).save()


def write_dumps(c: Crawl, path: str) -> None:
    """One dump a crawl."""
    write_files(dump_pieces(c), path)


def write_reports(reports: DataFrame, path: str, suffix: str) -> None:
    """One report a crawl, from (crawl_id, report); suffix: .json or .md."""
    write_files(reports.select(F.concat(quoted(F.col("crawl_id")), F.lit(suffix)).alias("name"), F.lit(0).alias("seq"), F.col("report").alias("text")), path)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class CrawlFiles(DataSource):
    """Sink of rows (name, text) that come sorted by name. A name that two tasks have written, or that is there already, fails the job."""

    @classmethod
    def name(cls) -> str:
        return "crawl_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> _Files:
        return _Files(self.options["path"])


class _Files(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.staging = path, f"_staging-{uuid.uuid4().hex}"

    def _open(self):
        fs, root = pafs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("/") else f"/{self.path}")
        return fs, root.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = self._open()
        own = f"{root}/{self.staging}/{uuid.uuid4().hex}"
        files, name, out = [], None, None
        try:
            for batch in iterator:
                for n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if n != name:
                        if out is not None:
                            out.close()
                        fs.create_dir(own, recursive=True)
                        name = n
                        files.append((f"{own}/{len(files)}", n))
                        out = fs.open_output_stream(files[-1][0])
                    out.write((text or "").encode("utf-8", "surrogatepass"))
        finally:
            if out is not None:
                out.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, root = self._open()
        files = [f for m in messages if m is not None for f in m.files]
        names = [n for _, n in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two tasks wrote one name")
        there = [i.path for i in fs.get_file_info([f"{root}/{quote(n, safe='%')}" for n in names]) if i.type != pafs.FileType.NotFound]
        if there:
            self.abort(messages)
            raise ValueError(f"{there[0]} is there already")
        for at, n in files:
            fs.move(at, f"{root}/{quote(n, safe='%')}")
        self._drop(fs, root)

    def abort(self, messages: list[_Written | None]) -> None:
        self._drop(*self._open())

    def _drop(self, fs, root: str) -> None:
        if fs.get_file_info(f"{root}/{self.staging}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.staging}")

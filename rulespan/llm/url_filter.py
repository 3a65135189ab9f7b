"""URL filters by sorted digest arrays.

A block list is kept as shards by digest range: sorted 64-bit xxhash digests, and
the strings they stand for.  Workers map the shards, probe them with
vectorised binary searches, and compare the whole string wherever a digest
agrees, so that collisions never block anything.  The list is sorted by Spark,
each range by one task; nothing of it passes the driver but the ranges' first digests.

URLs are compared in a normal form: lower case, without scheme, ``www.`` or ``m.``, query,
fragment, ``.html`` and closing slashes.  An entry is such a form, or a host by itself, which
blocks all its pages.  Defined cases: a null or empty URL is never blocked; null
entries are left out; repeated entries count once, repeated rows are judged alike; an empty list blocks nothing;
further columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespan.llm.arrays import mapped, save_arrays
from rulespan.llm.text import U, flat
from rulespan.shared import ship, work_dir

DIGEST_BITS = 64
SPAM_SHARE = 0.02


def normal_form(url: Column) -> Column:
    u = F.regexp_replace(F.lower(url), "^https?://", "")
    for pattern in ("^(www|m)[.]", "#.*$", "[?].*$", "/+$", "[.]html$", "/+$"):
        u = F.regexp_replace(u, pattern, "")
    return u


def host_of(form: Column) -> Column:
    return F.regexp_extract(form, "^[^/:]*", 0)


def digest(strings: list, bits: int = DIGEST_BITS) -> np.ndarray:
    import xxhash

    h = xxhash.xxh64_intdigest
    return np.fromiter((h(s) for s in strings), U, len(strings)) >> U(64 - bits)


class DigestSet:
    """lows: the least digest of each shard, ascending; paths: the shards."""

    def __init__(self, lows: np.ndarray, paths: list[str], bits: int = DIGEST_BITS):
        self.lows, self.paths, self.bits = lows, paths, bits

    def contains(self, strings: list) -> np.ndarray:
        """Of each string (not null). The search is one vectorised binary search a shard."""
        out = np.zeros(len(strings), bool)
        if not self.paths or not len(strings):
            return out
        d = digest(strings, self.bits)
        last = np.searchsorted(self.lows, d, "right") - 1
        for s in np.unique(last[last >= 0]).tolist():
            pick = np.flatnonzero(last == s)
            # equal digests never cross a border: a range's first digest is in one shard only
            a = mapped(self.paths[s])
            at = np.searchsorted(a["digests"], d[pick], "left")
            live = np.flatnonzero((at < len(a["digests"])))
            while len(live):
                live = live[a["digests"][at[live]] == d[pick[live]]]
                for k in live:
                    i = at[k]
                    raw = a["bytes"][a["ends"][i] : a["ends"][i + 1]].tobytes()
                    out[pick[k]] |= raw == strings[pick[k]].encode()
                live = live[~out[pick[live]]]
                at[live] += 1
                live = live[at[live] < len(a["digests"])]
        return out


def build(entries: DataFrame, bits: int = DIGEST_BITS) -> DigestSet:
    """Of the first column: strings."""
    spark = entries.sparkSession
    ship(spark)
    folder = work_dir(spark, "urls")
    s = F.col(f"`{entries.columns[0]}`").cast("string")
    rows = entries.select(s.alias("s")).filter("s is not null and s != ''").distinct()

    def hashed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("s"), pa.array((digest(b.column("s").to_pylist(), bits) ^ U(1 << 63)).view(np.int64))], names=["s", "d"])

    def write(batches):
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            d = t.column("d").to_numpy().view(U) ^ U(1 << 63)
            buf, offs = flat(t.column("s"))
            path = f"{folder}/{TaskContext.get().partitionId()}"
            save_arrays(path, {"digests": d, "ends": offs, "bytes": buf})
            yield pa.RecordBatch.from_arrays([pa.array([t.column("d")[0].as_py()]), pa.array([path])], names=["low", "path"])

    made = rows.mapInArrow(hashed, "s string, d long").repartitionByRange(F.col("d")).sortWithinPartitions("d", "s").mapInArrow(write, "low long, path string").collect()
    made.sort(key=lambda r: r.low)
    return DigestSet((np.array([r.low for r in made], np.int64).view(U) ^ U(1 << 63)), [r.path for r in made], bits)


def mark(pages: DataFrame, urls: DigestSet, hosts: DigestSet, name: str = "blocked_by") -> DataFrame:
    """pages with blocked_by: 'url', 'host' or null. The column gets underscores behind it if its name is taken."""
    ship(pages.sparkSession)
    while name in pages.columns:
        name += "_"
    form = normal_form(pages["url"].cast("string"))
    extra = [f"{name}_form", f"{name}_host"]
    while set(extra) & set(pages.columns):
        extra = [c + "_" for c in extra]
    k, names = len(pages.columns), [*pages.columns, name]

    def run(batches):
        for b in batches:
            form, host = b.column(k).to_pylist(), b.column(k + 1).to_pylist()
            out = np.full(b.num_rows, None, object)
            for values, found, what in ((host, hosts, "host"), (form, urls, "url")):
                has = np.array([i for i, x in enumerate(values) if x], np.int64)
                hit = found.contains([values[i] for i in has])
                out[has[hit]] = what
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(out.tolist(), pa.string())], names=names)

    return pages.withColumns({extra[0]: form, extra[1]: host_of(form)}).mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(name, T.StringType())]))


def corpus_block_list(pages: DataFrame, spam_share: float = SPAM_SHARE) -> tuple[DataFrame, DataFrame]:
    """(forms, hosts): pages that the crawl saw with a tracking parameter, and hosts with at least spam_share of all pages."""
    form = pages.filter("url is not null").select(normal_form(F.col("url")).alias("form"), "url")
    tracked = form.filter(F.col("url").rlike("[?&]utm_")).select("form").distinct()
    hosts = form.groupBy(host_of(F.col("form")).alias("host")).agg(F.count(F.lit(1)).alias("n"))
    total = form.agg(F.count(F.lit(1)).alias("total"))
    return tracked, hosts.crossJoin(F.broadcast(total)).filter(F.col("n") >= F.lit(spam_share) * F.col("total")).select("host")


def blocked_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, blocked_by of every page."""
    forms, hosts = corpus_block_list(pages)
    return mark(pages.select("page_id", "url"), build(forms), build(hosts))


def oracle(spam_share: float = SPAM_SHARE) -> str:
    form = "regexp_replace(lower(url), '^https?://', '')"
    for pattern in ("^(www|m)[.]", "#.*$", "[?].*$", "/+$", "[.]html$", "/+$"):
        form = f"regexp_replace({form}, '{pattern}', '')"
    return f"""
with f as (select page_id, url, {form} as form, regexp_extract({form}, '^[^/:]*', 0) as host from pages),
tracked as (select distinct form from f where regexp_matches(url, '[?&]utm_') and form <> ''),
spam as (select host from f where url is not null group by host
         having count(*) >= {spam_share} * (select count(*) from f where url is not null) and host <> '')
select page_id, url,
  case when form in (select form from tracked) then 'url' when host in (select host from spam) then 'host' end as blocked_by
from f"""

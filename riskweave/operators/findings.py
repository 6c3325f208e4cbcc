"""Reads of findings, scanner results and files: filters, orders, top-k, look-ups, deduplication."""

from __future__ import annotations

import functools
import heapq
import math
import re
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, paths, scores, text
from ..functions.columns import empty, lookup
from ..lineage import cut
from . import intervals


def severity_order(severity: Column) -> Column:
    """0 for critical to 4 for info, 5 for anything else."""
    return F.coalesce(5 - lookup(severity, fixed.SEVERITY_RANK), F.lit(5))


def listed(findings: DataFrame, limit: int = 500, severity: str | None = None, status: str | None = None, *ties: str) -> DataFrame:
    """Findings by severity, then confidence; the limit is the page."""
    for name, value in (("severity", severity), ("status", status)):
        findings = findings if value is None else findings.where(F.col(name) == value)
    return findings.orderBy(severity_order(F.col("severity")), F.desc("confidence"), *ties).limit(limit)


def dependency_order() -> list[Column]:
    """Order of dependency findings: risk (unknown last), severity, name."""
    return [F.desc_nulls_last("risk_score"), severity_order(F.col("severity")), F.lower("name")]


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def eligible_for_evidence(findings: DataFrame, deep: bool) -> DataFrame:
    """Confirmed findings worth exploit evidence, one of a (title, path, severity), best first."""
    severe = F.col("severity").isin("critical", "high") & (F.col("confidence") >= 0.55)
    medium = F.lit(deep) & (F.col("severity") == "medium") & ((F.col("confidence") >= 0.75) | F.coalesce(F.col("has_context"), F.lit(False)))
    rows = findings.where((F.col("status") == "confirmed") & (severe | medium))
    return top_per_group(rows, ["title", "file_path", "severity"], [F.desc("confidence"), F.col("finding_id")], 1)


def canonical_key(path: Column, category: Column, lines: Column, cwes: Column, sinks: Column, title: Column) -> Column:
    """What makes findings one: path, category, and the first there is of weaknesses, sink, line
    and title."""
    where = F.regexp_replace(F.lower(F.trim(F.translate(F.coalesce(path, F.lit("")), "\\", "/"))), "^[./]+", "")
    weak = F.array_join(F.array_sort(F.transform(F.slice(F.coalesce(cwes, empty()), 1, 3), lambda c: F.upper(c))), "|")
    sink = text.normal(F.try_element_at(sinks, F.lit(1)), 60)
    line = F.nullif(text.line_range(lines)["start"].cast("string"), F.lit("0"))
    anchor = F.coalesce(F.nullif(weak, F.lit("")), F.nullif(sink, F.lit("")), line, text.normal(title, 80))
    return F.concat_ws("|", *[F.nullif(c, F.lit("")) for c in (where, text.normal(category, 60), anchor)])


def merged_provenance(values: Column) -> Column:
    """llm, scanner, or hybrid where findings of both are merged; none counts as llm."""
    names = F.array_distinct(F.filter(F.transform(values, lambda v: F.lower(F.trim(F.coalesce(v, F.lit(""))))), lambda v: v != ""))
    return F.when(F.size(names) > 1, "hybrid").otherwise(F.coalesce(F.try_element_at(names, F.lit(1)), F.lit("llm")))


def merge_by_key(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Findings of one canonical key as one: highest severity and confidence, the title of the first
    by severity, confidence and id, the longest hypothesis (of equal ones the one of the least id),
    and how many titles there were. Titles are counted by a first group of key and title, so all that
    is shuffled is aggregated before."""
    rank, lowered = scores.severity_rank(F.col("severity")), F.lower(F.trim("title"))
    given = F.lower(F.trim(F.coalesce("provenance", F.lit(""))))
    one = findings.groupBy(*keys, lowered.alias("_title")).agg(
        F.max(F.struct(rank.alias("rank"), F.col("severity").alias("severity"))).alias("top"),
        F.max("confidence").alias("confidence"),
        F.min(F.struct((-rank).alias("rank"), (-F.col("confidence")).alias("low"), F.col("finding_id").alias("id"), F.col("title").alias("title"))).alias("first"),
        F.min(F.struct((-F.length(F.coalesce("hypothesis", F.lit("")))).alias("size"), F.col("finding_id").alias("id"), F.col("hypothesis").alias("hypothesis"))).alias("said"),
        F.min(F.nullif(given, F.lit(""))).alias("from"),
        F.max(F.nullif(given, F.lit(""))).alias("to"),
    )
    mixed = F.when(F.min("from") != F.max("to"), "hybrid").otherwise(F.coalesce(F.min("from"), F.lit("llm")))
    return one.groupBy(*keys).agg(
        F.max("top")["severity"].alias("severity"),
        F.max("confidence").alias("confidence"),
        F.min("first")["title"].alias("title"),
        F.min("said")["hypothesis"].alias("hypothesis"),
        F.count("_title").alias("merged_count"),
        mixed.alias("provenance"),
    )


def duplicates(a: str, b: str) -> Column:
    """Are two findings of one place probably one: do their lines overlap, do they share a weakness, or
    most words of their titles? a and b name the sides of a join of what ``read_for_duplicates`` gives."""
    x, y = F.col(f"{a}.lines"), F.col(f"{b}.lines")
    near = text.ranges_overlap(x["start"], x["end"], y["start"], y["end"])
    weak = F.arrays_overlap(F.col(f"{a}.cwe_ids"), F.col(f"{b}.cwe_ids"))
    alike = text.jaccard(F.col(f"{a}.words"), F.col(f"{b}.words")) >= 0.55
    return F.coalesce(near, F.lit(False)) | F.coalesce(weak, F.lit(False)) | alike


def read_for_duplicates(findings: DataFrame, *keep: str) -> DataFrame:
    """What tells duplicates, read once for a finding rather than for each of its pairs."""
    return findings.select(*keep, text.line_range(F.col("line_range")).alias("lines"), "cwe_ids", text.tokens(F.col("title")).alias("words"))


def duplicate_pairs(findings: DataFrame, place: str) -> DataFrame:
    """(a, b): findings of one place that probably are one, the lesser id first."""
    rows = read_for_duplicates(findings, place, "finding_id")
    pairs = rows.alias("a").join(rows.alias("b"), (F.col(f"a.{place}") == F.col(f"b.{place}")) & (F.col("a.finding_id") < F.col("b.finding_id")))
    return pairs.where(duplicates("a", "b")).select(F.col("a.finding_id").alias("a"), F.col("b.finding_id").alias("b"))


#: What the greedy merge reads of a finding; lists and texts may be null.
MERGE_SCHEMA = "finding_id string, title string, category string, severity string, file_path string, line_range string, hypothesis string, confidence double, provenance string, cwe_ids array<string>, sinks array<string>, input_sources array<string>, source_scanners array<string>, source_rules array<string>"


def greedy_merge(findings: DataFrame) -> DataFrame:
    """Merges findings into the first one of higher rank that they probably duplicate. The rank is
    severity, confidence, title; duplicates share the path and the category, so blocks of those are
    merged apart. Adds ``merged_count``, ``merged_titles`` and ``merged_ids``."""
    names = [c.split()[0] for c in MERGE_SCHEMA.split(", ")]
    where = F.regexp_replace(F.lower(F.trim(F.translate(F.coalesce("file_path", F.lit("")), "\\", "/"))), "^[./]+", "")
    rows = findings.select(*names, where.alias("_where"), text.normal(F.col("category"), 60).alias("_kind"))
    schema = MERGE_SCHEMA + ", merged_count int, merged_titles array<string>, merged_ids array<string>"
    return rows.groupBy("_where", "_kind").applyInArrow(_merge_block, schema)


LISTS = ("cwe_ids", "sinks", "input_sources", "source_scanners", "source_rules")
#: Lists of which two findings that are one may share a value.
SHARED = LISTS[:3]


class _Kept:
    """The findings of a block that are kept, found by what makes another one a duplicate of them: lines, a
    shared value, an anchor, or most words of the title. A finding that is kept was like none before, so
    the lines of those kept do not overlap; lists grow by what is merged, so values and anchors are entered as they
    come, and entries that no longer hold are dropped when met."""

    def __init__(self, lists):
        self.rows, self.lists, self.fields = [], lists, [k for k in SHARED if k in lists]
        self.values = {k: {} for k in self.fields}
        self.starts, self.ends, self.at = [], [], []
        self.anchors, self.titles, self.placed, self.postings, self.told = {}, [], {}, {}, {}

    @staticmethod
    def _first(index: dict, key, holds) -> int | None:
        heap = index.get(key)
        while heap and not holds(heap[0]):
            heapq.heappop(heap)
        return heap[0] if heap else None

    def first(self, r: dict) -> int | None:
        """The first kept finding that a finding duplicates."""
        none = best = len(self.rows)
        for k in self.fields:
            for v in r[k]:
                if v in self.values[k] and (i := self._first(self.values[k], v, lambda i: v in self.rows[i]["has"][k])) is not None:
                    best = min(best, i)
        if best and r["words"] and (i := self._by_title(r["words"])) is not None:
            best = min(best, i)
        if best and r["span"]:
            a, b = r["span"]
            at = bisect_left(self.ends, a)
            while at < len(self.starts) and self.starts[at] <= b:
                best = min(best, self.at[at])
                at += 1
        if best and (i := self._first(self.anchors, anchor := _anchor(r), lambda i: self.rows[i]["anchor"] == anchor)) is not None:
            best = min(best, i)
        return best if best < none else None

    def _by_title(self, words: frozenset) -> int | None:
        """The first with most words in common. Of so many words one at least must be shared, the rarest are
        asked; what was seen for the same words before is not looked at again."""
        seen, known = self.told.get(words, (0, None))
        if known is None and seen < len(self.titles):
            fewest = len(words) - math.ceil(0.55 * len(words) - 1e-9) + 1
            rare = sorted((self.postings.get(w, ()) for w in words), key=len)[:fewest]
            for i in sorted({i for p in rare for i in p[bisect_left(p, seen) :]}):
                other = self.titles[i]
                if len(words & other) / len(words | other) >= 0.55:
                    known = self.placed[other]
                    break
            self.told[words] = (len(self.titles), known)
        return known

    def _enter(self, i: int, k: str, values) -> None:
        for v in values:
            heapq.heappush(self.values[k].setdefault(v, []), i)

    def keep(self, r: dict) -> None:
        i = len(self.rows)
        self.rows.append(r)
        r["anchor"], r["has"], r["seen"] = _anchor(r), {k: set(r[k]) for k in self.fields}, None
        r["merged_titles"], r["merged_ids"] = [r["title"]], [r["finding_id"]]
        for k in self.fields:
            self._enter(i, k, r["has"][k])
        heapq.heappush(self.anchors.setdefault(r["anchor"], []), i)
        if r["span"]:
            at = bisect_left(self.starts, r["span"][0])
            for held, value in ((self.starts, r["span"][0]), (self.ends, r["span"][1]), (self.at, i)):
                held.insert(at, value)
        words = r["words"]
        if words and words not in self.placed:
            self.placed[words] = i
            for w in words:
                self.postings.setdefault(w, []).append(len(self.titles))
            self.titles.append(words)

    def _unite(self, i: int, k: str, values) -> bool:
        """Adds values to a list, trimmed, each but once whatever its case; has that changed the list?"""
        into, changed = self.rows[i], False
        known, seen = into["known"][k], into["seen"][k]
        for raw in values:
            if raw in known:
                continue
            known.add(raw)
            v = str(raw or "").strip()
            if v and v.lower() not in seen:
                seen.add(v.lower())
                into[k].append(v)
                changed = True
                if k in self.fields:
                    into["has"][k].add(v)
                    self._enter(i, k, [v])
        return changed

    def merge(self, i: int, r: dict) -> None:
        into, changed = self.rows[i], False
        if into["seen"] is None:
            changed = True
            into["seen"], into["known"] = ({k: set() for k in (*LISTS, "merged_titles")} for _ in range(2))
            for k in into["seen"]:
                values, into[k] = into[k], []
                if k in self.fields:
                    into["has"][k] = set()
                self._unite(i, k, values)
        if r["confidence"] > into["confidence"]:
            into["confidence"] = r["confidence"]
        if r["size"] > into["size"]:
            into["hypothesis"], into["size"] = r["hypothesis"], r["size"]
        for k in self.lists:
            if r[k] and self._unite(i, k, r[k]):
                changed = True
        self._unite(i, "merged_titles", (r["title"],))
        into["merged_ids"].append(r["finding_id"])
        if r["provenance"] != into["provenance"] or into["provenance"] not in ("llm", "scanner", "hybrid"):
            both = {(x["provenance"] or "").strip().lower() for x in (into, r)} - {""}
            into["provenance"] = "hybrid" if len(both) > 1 else next(iter(both), "llm")
        if changed and (anchor := _anchor(into)) != into["anchor"]:
            into["anchor"] = anchor
            heapq.heappush(self.anchors.setdefault(anchor, []), i)


def _tidy(value, n: int) -> str:
    return re.sub(r"\s+", " ", (value or "").strip()).lower()[:n]


@functools.lru_cache(1 << 16)
def _span(value) -> tuple[int, int] | None:
    m = re.match(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", value or "")
    ends = sorted(int(x) for x in m.groups() if x) if m else []
    return (ends[0], ends[-1]) if ends and ends[0] else None


@functools.lru_cache(1 << 16)
def _words(value) -> frozenset:
    return frozenset(w for w in re.split("[^a-z0-9]+", (value or "").lower()) if len(w) >= 3)


def _anchor(a: dict) -> str:
    return "|".join(sorted(c.upper() for c in a.get("cwe_ids", ())[:3])) or (_tidy(a["sinks"][0], 60) if a.get("sinks") else "") or (str(a["span"][0]) if a["span"] else _tidy(a["title"], 80))


def _merge_block(block):
    """A block's findings by rank, each kept or merged into the first one kept that it duplicates. Columns are
    sorted and measured whole; a row is looked at once, against indexes of what is kept."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names = [c.split()[0] for c in MERGE_SCHEMA.split(", ")]
    rank = pc.dictionary_encode(pc.fill_null(block["severity"], "")).combine_chunks()
    places = np.array([-fixed.SEVERITY_RANK.get(s.lower(), 0) for s in rank.dictionary.to_pylist()])[rank.indices.to_numpy()]
    sure = np.nan_to_num(pc.fill_null(block["confidence"], 0.0).to_numpy(), nan=0.0, posinf=np.inf, neginf=-np.inf)
    keys = pa.table({"rank": places, "sure": -sure, "title": pc.fill_null(block["title"], ""), "id": pc.fill_null(block["finding_id"], "")})
    order = pc.sort_indices(keys, [(k, "ascending") for k in keys.column_names])
    block, n = block.select(names).take(order), len(order)
    blank = {k: () for k in LISTS if not len(pc.list_flatten(block[k]))}
    filled = [k for k in LISTS if k not in blank]
    columns = {k: block[k].to_pylist() for k in names if k not in ("confidence", "severity", "category", "file_path") and k not in blank}
    columns |= {"confidence": sure[order.to_numpy()].tolist(), "size": pc.fill_null(pc.utf8_length(block["hypothesis"]), 0).to_pylist()}
    kept, places = _Kept(filled), []
    for i, values in enumerate(zip(*columns.values(), strict=True)):
        r = dict(zip(columns, values, strict=True))
        for k in filled:
            r[k] = r[k] or ()
        r["span"], r["words"] = _span(r["line_range"]), _words(r["title"])
        into = kept.first(r)
        if into is None:
            kept.keep(r | blank)
            places.append(i)
        else:
            kept.merge(into, r)
    whole = block.select(["severity", "category", "file_path"]).take(places)
    text, texts = pa.string(), pa.list_(pa.string())
    out = {k: whole[k] if k in whole.column_names else pa.array([list(r[k]) if k in LISTS else r[k] for r in kept.rows], texts if k in LISTS else pa.float64() if k == "confidence" else text) for k in names}
    out["merged_count"] = pa.array([len(r["merged_titles"]) for r in kept.rows], pa.int32())
    out |= {k: pa.array([r[k] for r in kept.rows], texts) for k in ("merged_titles", "merged_ids")}
    return pa.table(out)


def merge_advisories(matches: DataFrame, keys: list[str], limit: int = 5) -> DataFrame:
    """Related advisories of a finding: of rows with one display id the strongest wins, evidence is
    united, and the best few stay."""
    strength = lookup(F.col("evidence_strength"), {"strong": 3, "medium": 2, "weak": 1, "contextual": 0}, 0)
    order = [F.desc(strength), F.desc_nulls_last("package_match_confidence"), F.desc(scores.severity_rank(F.col("severity")))]
    w = Window.partitionBy(*keys, "display_id")
    rows = matches.withColumn("_r", F.row_number().over(w.orderBy(*order)))
    for c, source in (("evidence_types", "evidence_type"), ("evidence_sources", "package_evidence_source")):
        rows = rows.withColumn(c, F.sort_array(F.collect_set(source).over(w)))
    for c in ("function", "line"):
        rows = rows.withColumn(c, F.coalesce(c, F.first(c, True).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return top_per_group(rows.where("_r = 1").drop("_r"), keys, [*order, F.col("display_id")], limit)


#: Findings, or hits, of a file that one task matches; those of larger files meet by blocks.
WHOLE_FILE = 20_000
#: Files whose names are broadcast; more are joined.
FEW_FILES = 100_000


def match_hits(findings: DataFrame, hits: DataFrame, limit: int = 5) -> DataFrame:
    """Scanner hits of a finding: in its file, with lines that overlap or words of its category; the
    first so many by id, then rule. A range without an end is one line.

    Files come sorted to the tasks, so findings and hits are shuffled once and their matches nowhere. Files too large for
    one task, and those that share the id of a finding, go by blocks."""
    start = lambda c: F.when(F.coalesce(c, F.lit(0)) != 0, c)
    a = findings.where("file_path is not null").select("finding_id", "file_path", F.lower(F.coalesce("category", F.lit(""))).alias("category"), start(F.col("start_line")).alias("a"), F.coalesce("end_line", "start_line").alias("b"))
    b = hits.where("file_path is not null").select("hit_id", "rule_id", "message", "scanner", "file_path", start(F.col("start_line")).alias("x"), F.coalesce("end_line", "start_line").alias("y"))
    files = cut(_files_by_blocks(a, b))
    names = _few(files)
    apart = lambda how: [df.join(names, "file_path", how) for df in (a, b)]
    return _hits_in_order(*apart("left_anti"), limit).unionByName(_hits_by_blocks(*apart("left_semi"), limit))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW_FILES else df


def _files_by_blocks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Files with too many findings or hits for one task, or with a finding whose id another file has, too."""
    sides = a.select("file_path", F.lit(0).alias("_side")).unionByName(b.select("file_path", F.lit(1).alias("_side")))
    large = sides.groupBy("file_path", "_side").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE_FILE).select("file_path")
    # ids alone are shuffled; the files are compared of those that repeat
    again = cut(a.select("finding_id").repartition("finding_id").groupBy("finding_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("finding_id").alias("_id")))
    if again.isEmpty():
        return large.distinct()
    places = a.join(_few(again), F.col("finding_id").eqNullSafe(F.col("_id")), "left_semi").select("finding_id", "file_path").distinct()
    shared = places.withColumn("n", F.count("*").over(Window.partitionBy("finding_id"))).where("n > 1").select("file_path")
    return large.unionByName(shared).distinct()


def _hits_in_order(a: DataFrame, b: DataFrame, limit: int) -> DataFrame:
    """Hits of the findings of files of which each fits a task."""
    said = lookup(F.col("category"), {c: 1 << i for i, c in enumerate(fixed.CATEGORY_WORDS)}, 0)
    one = a.select("file_path", F.lit(0).alias("side"), "finding_id", said.cast("long").alias("said"), F.col("a").cast("long").alias("low"), F.col("b").cast("long").alias("high"))
    two = b.select("file_path", F.lit(1).alias("side"), "hit_id", "rule_id", text.categories_said(F.col("rule_id"), F.col("message"), F.col("scanner")).alias("said"), F.col("x").cast("long").alias("low"), F.col("y").cast("long").alias("high"))
    rows = one.unionByName(two, allowMissingColumns=True)
    types = dict(rows.dtypes)
    order = ["file_path", "side", "finding_id", "hit_id", "rule_id"]
    return rows.repartition("file_path").sortWithinPartitions(*order).select(*order, "said", "low", "high").mapInArrow(_match_files(limit), ", ".join(f"{c} {types[c]}" for c in ("finding_id", "hit_id", "rule_id")))


def _match_files(limit: int):
    """Sorted rows of findings (side 0) and hits to (finding_id, hit_id, rule_id), file by file."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def begins(column):
            """Where a value differs from the one before it; nulls are equal."""
            if len(column) < 2:
                return np.ones(len(column), dtype=bool)
            p, q = column[1:], column[:-1]
            same = pc.fill_null(pc.equal(p, q), pc.and_(pc.is_null(p), pc.is_null(q))) if column.null_count else pc.equal(p, q)
            return np.concatenate([[True], ~np.asarray(same)])

        def pairs(fs, fa, fb, hs, hx, hy):
            """Findings and their first hits by place; findings of the same lines and category are matched once."""
            spots, which = np.arange(len(fs)), np.arange(len(fs))
            if len(fs) * len(hs) > 1 << 16:
                by = np.lexsort((fb, fa, fs))
                new = np.concatenate([[True], (np.diff(fs[by]) != 0) | (np.diff(fa[by]) != 0) | (np.diff(fb[by]) != 0)])
                spots = by[new]
                which[by] = np.cumsum(new) - 1
            fs, fa, fb = fs[spots], fa[spots], fb[spots]
            left, found, got = np.arange(len(spots)), np.zeros(len(spots), dtype=np.int64), []
            at = 0
            while at < len(hs) and len(left):
                to = at + max(64, (1 << 18) // len(left))
                m = (fa[left, None] <= hy[at:to]) & (hx[at:to] <= fb[left, None])
                if fs.any():
                    m |= (fs[left, None] & hs[at:to]) != 0
                r, h = np.nonzero(m)
                n = np.bincount(r, minlength=len(left))
                keep = np.arange(len(r)) - (np.cumsum(n) - n)[r] + found[left][r] < limit
                got.append((left[r[keep]], h[keep] + at))
                found[left] = np.minimum(found[left] + n, limit)
                left, at = left[found[left] < limit], to
            spot, hit = (np.concatenate(x) for x in zip(*got, strict=True))
            hit = hit[np.argsort(spot, kind="stable")]
            n = found[which]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            return np.repeat(np.arange(len(which)), n), hit[np.repeat((np.cumsum(found) - found)[which], n) + place]

        def matched(held):
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            side, said = (batch.column(c).to_numpy() for c in ("side", "said"))
            low, high = batch.column("low"), batch.column("high")
            known = ~np.asarray(pc.is_null(low).to_numpy(zero_copy_only=False))
            least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
            low, high = (np.where(known, pc.fill_null(c, 0).to_numpy(), x) for c, x in ((low, most), (high, least)))
            new = begins(batch.column("file_path"))
            ends = np.append(np.flatnonzero(new)[1:], len(new))
            out = []
            for s, e in zip(np.flatnonzero(new), ends, strict=True):
                m = s + np.searchsorted(side[s:e], 1)
                if s < m < e:
                    f, h = pairs(said[s:m], low[s:m], high[s:m], said[m:e], low[m:e], high[m:e])
                    out.append((f + s, h + m))
            if not out:
                return None
            f, h = (np.concatenate(x) for x in zip(*out, strict=True))
            # rows of one id in a file share the first hits
            one = np.cumsum(new | begins(batch.column("finding_id")))
            if len(np.unique(one[side == 0])) < (side == 0).sum():
                by = np.lexsort((h, one[f]))
                f, h = f[by], h[by]
                n = np.unique(one[f], return_counts=True)[1]
                keep = np.arange(len(f)) - np.repeat(np.cumsum(n) - n, n) < limit
                f, h = f[keep], h[keep]
            f, h = pa.array(f), pa.array(h)
            return pa.RecordBatch.from_arrays([batch.column("finding_id").take(f), batch.column("hit_id").take(h), batch.column("rule_id").take(h)], ["finding_id", "hit_id", "rule_id"])

        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column("file_path")
            last = int(np.flatnonzero(begins(path))[-1])
            if last or (held and held[-1].column("file_path")[-1] != path[0]):
                done = matched([*held, batch.slice(0, last)]) if last else matched(held)
                held = []
                if done is not None:
                    yield done
            held.append(batch.slice(last))
        done = matched(held) if held else None
        if done is not None:
            yield done

    return run


def _hits_by_blocks(a: DataFrame, b: DataFrame, limit: int) -> DataFrame:
    """Hits of the findings of files of any size.

    Ranges that overlap hold each other's beginnings, so beginnings meet blocks of ranges; words meet by
    category. Of each block, and of each category of a file, the first hits suffice, so a file with
    very many findings and hits is no product. Ranges that end before they begin are tested by file."""
    order = [F.col("hit_id"), F.col("rule_id")]
    good_a, good_b = F.coalesce(F.col("b") >= F.col("a"), F.lit(False)), F.coalesce(F.col("y") >= F.col("x"), F.lit(False))
    keys, hit = ["file_path", *intervals.KEYS], ["finding_id", "hit_id", "rule_id"]
    good, whole = a.where(good_a), b.where(good_b)
    # each pair comes about in one way: the hit begins in the finding, or before it, or is told by words alone
    begun = intervals.first_of(intervals.at_place(whole, F.col("x"), intervals.top(good, F.col("a"), F.col("b"))), ["file_path"], order, limit)
    over = intervals.in_blocks(good, F.col("a"), F.col("b")).join(begun, keys).select(*hit)
    held = intervals.first_of(intervals.in_blocks(whole, F.col("x"), F.col("y")), ["file_path"], order, limit)
    under = intervals.at_place(good, F.col("a"), intervals.top(whole, F.col("x"), F.col("y"))).join(held, keys).where(F.col("x") < F.col("a")).select(*hit)
    near = F.coalesce((F.col("a") <= F.col("y")) & (F.col("x") <= F.col("b")), F.lit(False))
    odd = [p.join(q, "file_path").where(near).select(*hit) for p, q in ((a.where(~good_a & F.col("a").isNotNull()), b), (good, b.where(~good_b)))]
    words = F.array_compact(F.array(*[F.when(text.category_matches(F.lit(c), F.col("rule_id"), F.col("message"), F.col("scanner")), F.lit(c)) for c in fixed.CATEGORY_WORDS]))
    said = top_per_group(b.select("file_path", F.explode(words).alias("category"), "hit_id", "rule_id", "x", "y"), ["file_path", "category"], order, limit)
    by_words = a.join(said, ["file_path", "category"]).where(~near).select(*hit)
    rows = over.unionByName(under).unionByName(odd[0]).unionByName(odd[1]).unionByName(by_words)
    return top_per_group(rows, ["finding_id"], order, limit)


def hit_context(hits: DataFrame, limit: int = 60) -> DataFrame:
    """Hits in the order in which an investigation reads them."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in fixed.SCANNER_ORDER]), F.col("scanner")), F.lit(0)) - 1, F.lit(9))
    return hits.orderBy(rank, severity_order(F.coalesce("severity", F.lit("info"))), F.when(F.col("rich"), 0).otherwise(1), F.coalesce("line", F.lit(0)), "hit_id").limit(limit)


def reprioritised(files: DataFrame, boosts: DataFrame, inspected: DataFrame) -> DataFrame:
    """Files not inspected yet by static score plus boosts. boosts are events (file_path, boost);
    a negative one counts as a reference, too."""
    added = boosts.groupBy("file_path").agg(F.sum("boost").alias("dynamic"), F.count("*").alias("referenced"))
    rows = files.join(inspected.select("file_path"), "file_path", "left_anti").join(added, "file_path", "left")
    return rows.withColumn("effective", F.col("score") + F.coalesce("dynamic", F.lit(0.0))).withColumn("referenced", F.coalesce("referenced", F.lit(0)))


def hit_boosts(hits: DataFrame, boost: float = 5.0) -> DataFrame:
    """Boost events (file_path, boost) of new hits whose file is known."""
    return hits.where("file_path is not null").select("file_path", F.lit(boost).alias("boost"))


def accumulated(boosts: DataFrame) -> DataFrame:
    """What all boost events add up to, by file."""
    return boosts.groupBy("file_path").agg(F.sum("boost").alias("boost"), F.count("*").alias("events"))


def hot_files(queue: DataFrame, limit: int = 10) -> DataFrame:
    return queue.where("dynamic > 0").orderBy(F.desc("effective"), "file_path").limit(limit)


def persist_new(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose keys (nulls equal) no row has yet, each key once."""
    same = [new[k].eqNullSafe(existing[k]) for k in keys]
    out = same[0]
    for c in same[1:]:
        out = out & c
    return new.join(existing, out, "left_anti").dropDuplicates(keys)


def dedupe_flows(flows: DataFrame) -> DataFrame:
    """Taint flows of one source and sink as one; sanitised if any is."""
    keys = ["source_file", "source_line", "source_type", "sink_file", "sink_line", "sink_type"]
    return flows.groupBy(*keys).agg(F.bool_or("sanitised").alias("sanitised"), F.max("confidence").alias("confidence"), F.max_by("intermediaries", F.size("intermediaries")).alias("intermediaries"))


#: Findings of a scan that one task gathers; larger scans are gathered by rounds.
WHOLE_SCAN = 10_000


def clusters(findings: DataFrame) -> DataFrame:
    """Greedy clusters of a scan: the first free finding gathers the free ones of its file, category or
    directory; clusters of one are left out, the others numbered in order. Rows that repeat are one; those without a
    scan or an id belong to no cluster. Scans come sorted to the tasks, so their rows are shuffled once; those
    too large for one task are gathered by rounds."""
    # at most one scan for each WHOLE_SCAN rows
    large = cut(findings.where("scan_id is not null and finding_id is not null").groupBy("scan_id").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE_SCAN).select("scan_id"))
    if large.isEmpty():
        return _clusters_in_order(findings)
    return _clusters_in_order(findings.join(F.broadcast(large), "scan_id", "left_anti")).unionByName(_clusters_by_rounds(findings.join(F.broadcast(large), "scan_id", "left_semi")))


def _clusters_in_order(findings: DataFrame) -> DataFrame:
    """The clusters of scans of which each fits a task: who shares a key with an earlier leader belongs to the
    earliest such, anyone else leads."""
    home = F.regexp_extract("file_path", "^(.*)/[^/]*$", 1)
    key = F.when(F.col("file_path").contains("/") & (home != ""), F.concat(F.lit("d"), home)).otherwise(F.concat(F.lit("f"), F.col("file_path")))
    rows = findings.where("scan_id is not null and finding_id is not null").select("scan_id", "finding_id", F.coalesce("file_path", F.lit("")).alias("file_path"), F.coalesce("category", F.lit("")).alias("category"))
    schema = f"scan_id {rows.schema['scan_id'].dataType.simpleString()}, cluster int, finding_id {rows.schema['finding_id'].dataType.simpleString()}"

    def run(batches):
        import pyarrow as pa

        scan = last = types = None
        led, groups, out = {}, [], ([], [], [])

        def close():
            for n, group in enumerate(g for g in groups if len(g) > 1):
                for column, values in zip(out, ([scan] * len(group), [n] * len(group), group), strict=True):
                    column.extend(values)

        def made():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["scan_id", "cluster", "finding_id"])
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            types = (batch.schema.field(0).type, pa.int32(), batch.schema.field(1).type)
            for s, i, path, category, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != scan:
                    close()
                    scan, last, led, groups = s, None, {}, []
                if last == (i, path, category):
                    continue
                last, category = (i, path, category), "c" + category
                first, other = led.get(category), led.get(place)
                at = other if first is None else first if other is None else min(first, other)
                if at is None:
                    at = led[category] = led[place] = len(groups)
                    groups.append([])
                groups[at].append(i)
            yield made()
        if types:
            close()
            yield made()

    order = ["scan_id", "finding_id", "file_path", "category"]
    found = rows.repartition("scan_id").sortWithinPartitions(*order).select(*order, key.alias("place")).mapInArrow(run, schema)
    return found.select(F.col("scan_id").cast("long"), "cluster", F.col("finding_id").cast("long"))


def _clusters_by_rounds(findings: DataFrame) -> DataFrame:
    """The clusters of scans of any size.

    A finding leads a cluster if no earlier leader shares a key with it. So whoever comes first under all
    of its keys leads, those that share a key with a leader are out, and so on: rounds of aggregates and
    joins on keys, in which a scan or a key of any size is spread. Then each finding goes to its earliest
    leader; under one key there is one leader at most."""
    home = F.regexp_extract("file_path", "^(.*)/[^/]*$", 1)
    key = lambda kind, value: F.concat(F.lit(kind), value)
    # findings of one file share its directory; only at the root the file counts by itself
    keys = F.array(key("c", F.col("category")), F.when(F.col("file_path").contains("/") & (home != ""), key("d", home)).otherwise(key("f", F.col("file_path"))))
    rows = findings.where("scan_id is not null and finding_id is not null").select("scan_id", F.struct("finding_id", F.coalesce("file_path", F.lit("")).alias("file_path"), F.coalesce("category", F.lit("")).alias("category")).alias("row"))
    rows = cut(rows.distinct().select("scan_id", "row", "row.file_path", "row.category").select("scan_id", "row", keys.alias("keys")))
    under = lambda df: df.select("scan_id", "row", F.explode("keys").alias("key"))
    active, leaders = rows, None
    while not active.isEmpty():
        first = under(active).groupBy("scan_id", "key").agg(F.min("row").alias("first"))
        lead = under(active).join(first, ["scan_id", "key"]).groupBy("scan_id", "row").agg(F.bool_and(F.col("row") == F.col("first")).alias("leads")).where("leads").drop("leads")
        lead = cut(active.join(lead, ["scan_id", "row"], "left_semi"))
        leaders = lead if leaders is None else leaders.unionByName(lead)
        out = under(active).join(under(lead).select("scan_id", "key").distinct(), ["scan_id", "key"], "left_semi").select("scan_id", "row").distinct()
        active = cut(active.join(out, ["scan_id", "row"], "left_anti"))
    if leaders is None:
        return rows.select(F.col("scan_id").cast("long"), F.lit(0).alias("cluster"), F.col("row.finding_id").cast("long").alias("finding_id"))
    led = under(rows).join(under(leaders).select("scan_id", "key", F.col("row").alias("leader")), ["scan_id", "key"]).groupBy("scan_id", "row").agg(F.min("leader").alias("leader"))
    large = led.groupBy("scan_id", "leader").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    place = F.row_number().over(Window.partitionBy("scan_id").orderBy("leader")) - 1
    return led.join(large.withColumn("cluster", place), ["scan_id", "leader"]).select(F.col("scan_id").cast("long"), F.col("cluster").cast("int"), F.col("row.finding_id").cast("long").alias("finding_id"))


def guardrails(findings: DataFrame, context: Column) -> DataFrame:
    """Severe data-flow findings without a context are lowered to medium, or dismissed where their
    path is a test, an example or a document."""
    gap = (F.coalesce("status", F.lit("")) != "dismissed") & F.col("severity").isin("critical", "high") & F.col("needs_context") & ~context
    low = paths.low_context(F.col("file_path"))
    return findings.withColumns({
        "status": F.when(gap & low, "dismissed").otherwise(F.col("status")),
        "severity": F.when(gap & low, "info").when(gap, "medium").otherwise(F.col("severity")),
        "confidence": F.when(gap & low, F.least("confidence", F.lit(0.1))).when(gap, F.least("confidence", F.lit(0.6))).otherwise(F.col("confidence")),
    })

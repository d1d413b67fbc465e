"""Secret scans over an incremental blob ledger. Native expressions only.

Every version of every text is content-addressed by its SHA-256; the ledger has a row for each (blob, rule, version)
pair that was scanned, with the spans found. ``scan`` looks only at pairs that the ledger lacks, each blob once however
many paths hold it, and ``findings`` joins the ledger's spans back to all paths. ``ingest`` keeps the ledger as a Parquet
dataset: each arrival of versions is scanned against what is there, and its new rows are appended in one commit, so a run
that is stopped and begun again scans only what it hasn't recorded.

Rules find leftmost non-overlapping matches; a match that is too short is dropped after it has consumed its
characters. Spans are in code points, ends exclusive. Running sums over a text's matches are taken in blocks of the square
root of their number, and texts are cut in pieces of PIECE characters before parts are taken out, so that work
doesn't grow with the square of either.

Nulls count as empty texts, an empty table gives an empty result, repeated rows are repeated paths of one blob, and only
the named columns are read, so extra ones do no harm. Ledger rows that two runs have both appended count once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEDGER = "blob string, rule string, version int, spans array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A Java pattern; least is the number of characters that its group of that number has at least."""

    name: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 1
    base: bool = False


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=8, base=True),
    # Maximal runs, so a bound inside the pattern finds what dropping short runs afterwards leaves.
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    # A token starts where its run of characters starts, so that no run is read more than three times.
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    # The key with its last line, or else what looks like its lines.
    Rule("pem", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s:,-]{0,16384}?-----END [A-Z ]{0,32}PRIVATE KEY-----|(?:\s{0,4}[A-Za-z0-9+/=]{40,}+){0,256}+)"),
)

#: Characters that a text is cut into before parts of it are taken out.
PIECE = 4096
_NO_SPANS = "cast(array() as array<struct<start:int,end:int>>)"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(xs: Column, add: Callable[[Column, Column], Column]) -> Column:
    """What ``add`` (associative, with 0 as its zero) makes of all that stands before each element of a non-empty array of ints."""
    nothing = F.expr("cast(array() as array<int>)")
    begin = F.struct(F.lit(0).alias("at"), nothing.alias("seen"))
    step = lambda s, x: F.struct(add(s["at"], x).alias("at"), F.concat(s["seen"], F.array(s["at"])).alias("seen"))

    def blocks(at: Column) -> Column:
        xs, width = at["xs"], at["width"]
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / width).cast("int")), lambda j: F.aggregate(F.slice(xs, j * width + 1, width), begin, step))

    def shifted(inner: Column) -> Column:
        ahead = F.aggregate(inner, begin, lambda s, b: step(s, b["at"]), lambda s: s["seen"])
        return _let(F.struct(inner.alias("inner"), ahead.alias("ahead")), lambda x: F.flatten(F.transform(x["inner"], lambda b, j: F.transform(b["seen"], lambda y: add(F.get(x["ahead"], j), y)))))

    sized = F.struct(xs.alias("xs"), F.ceil(F.sqrt(F.size(xs))).cast("int").alias("width"))
    return _let(_let(sized, blocks), shifted)


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of the rule's matches: lengths of what lies between matches and of matches, added up."""
    none = F.expr(_NO_SPANS)
    between, matches = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    of = lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)) if rule.group else F.length(m)
    step = _let(
        F.struct(between.alias("between"), matches.alias("matches")),
        lambda x: F.transform(x["matches"], lambda m, i: F.struct(F.length(F.get(x["between"], i)).alias("gap"), F.length(m).alias("len"), of(m).alias("of"))),
    )

    def placed(steps: Column) -> Column:
        ends = _before(F.transform(steps, lambda x: x["gap"] + x["len"]), lambda a, b: a + b)
        every = _let(ends, lambda at: F.transform(steps, lambda x, i: F.struct((F.get(at, i) + x["gap"]).alias("start"), (F.get(at, i) + x["gap"] + x["len"]).alias("end"), x["of"].alias("of"))))
        return F.transform(F.filter(every, lambda x: x["of"] >= rule.least), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    return F.when(text.rlike(rule.pattern), _let(step, placed)).otherwise(none)


def address(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def scan(versions: DataFrame, text: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows: for each blob of versions, the rules that the ledger hasn't applied to it in their version."""
    bodies = versions.select(address(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    # The first text of an address: copies meet in the map tasks, before the shuffle.
    bodies = bodies.groupBy("blob").agg(F.first("body").alias("body"))
    wanted = lambda rule: F.lit(True)
    if ledger is not None:
        done = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", F.col("version").cast("string"))).alias("done"))
        bodies = bodies.join(done, "blob", "left")
        wanted = lambda rule: ~F.coalesce(F.array_contains("done", f"{rule.name}:{rule.version}"), F.lit(False))
    entry = lambda rule: F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version"), spans(F.col("body"), rule).alias("spans"))
    each = F.array_compact(F.array(*[F.when(wanted(rule), entry(rule)) for rule in rules]))
    return bodies.select("blob", F.inline(each))


def update(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger after scanning versions."""
    new = scan(versions, text, ledger, rules)
    return new if ledger is None else ledger.select("blob", "rule", "version", "spans").unionByName(new)


def ingest(arrivals: list[DataFrame], path: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan each arrival of versions against the ledger at ``path`` and append what is new; the ledger."""
    spark = arrivals[0].sparkSession
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(path)
    read = lambda: spark.read.schema(LEDGER).parquet(path)
    for versions in arrivals:
        # An empty ledger has nothing to join with.
        known = read()
        scan(versions, text, None if known.isEmpty() else known, rules).write.mode("append").parquet(path)
    return read()


def by_blob(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, found) of blobs with findings, by the rules' present versions: a written table, whose size plans know."""
    number = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(f"{r.name}:{r.version}"), F.lit(i))])
    hits = ledger.withColumn("kind", F.get(F.array(number[F.concat_ws(":", "rule", F.col("version").cast("string"))]), F.lit(0)))
    hits = hits.where(F.col("kind").isNotNull() & (F.size("spans") > 0))
    hits = hits.groupBy("blob", "kind").agg(F.first("spans").alias("spans"))
    triples = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("kind").alias("kind"), s["end"].alias("end")))
    # As many rows for a blob as there are rules.
    return common.written(hits.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list(triples))).alias("found")), "secret-findings")


def findings(versions: DataFrame, ledger: DataFrame, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, found): found has (start, kind number, end) by start, then kind, of the rules' present versions.

    A row for each row of versions, found empty where the ledger has no span. The findings by blob are a written table, so
    the join broadcasts them by their known size, or adaptive execution splits a blob of very many paths.
    """
    paths = versions.select(F.col(path).alias("path"), address(text).alias("blob"))
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    return paths.join(by_blob(ledger, rules), "blob", "left").select(F.col("path").alias(path), "blob", F.coalesce("found", empty).alias("found"))


def redact(text: Column, found: Column, mark: str = "[REDACTED]") -> Column:
    """The text with every span, overlapping ones as one, replaced by the mark. found is in order of start."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def part(cut: Column, a: Column, b: Column) -> Column:
        """Characters a to b (exclusive) of the text."""
        first = F.floor(a / PIECE).cast("int")
        several = F.slice(cut, first + 1, F.floor((b - 1) / PIECE).cast("int") - first + 1)

        def inside(piece: Column, j: Column) -> Column:
            at = (first + j) * PIECE
            low = F.greatest(a - at, F.lit(0))
            return F.substr(piece, low + 1, F.least(b - at, F.lit(PIECE)) - low)

        return F.when(b > a, F.array_join(F.transform(several, inside), "")).otherwise("")

    def whole(x: Column) -> Column:
        cut, found, reached, n = x["cut"], x["found"], x["reached"], x["n"]
        spans_ = F.transform(found, lambda s, i: F.struct(F.get(reached, i).alias("at"), s["start"].alias("start")))
        fresh = F.filter(spans_, lambda s: s["start"] >= s["at"])
        body = F.array_join(F.transform(fresh, lambda s: F.concat(part(cut, s["at"], s["start"]), F.lit(mark))), "")
        return F.concat(body, part(cut, F.array_max(F.transform(found, lambda s: s["end"])), n))

    reached = _before(F.transform(found, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    done = _let(F.struct(pieces.alias("cut"), found.alias("found"), reached.alias("reached"), F.length(text).alias("n")), whole)
    return F.when(F.size(found) > 0, done).otherwise(text)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    # Two arrivals, as a crawl brings them: a text of the second that stood in the first is not scanned again.
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    ledger = ingest([documents.where(english), documents.where(~english)], common.shared_path(spark, "secret-ledger"))
    found = findings(documents, ledger)
    names = F.array(*[F.lit(r.name) for r in RULES])
    base = [i for i, r in enumerate(RULES) if r.base]
    shown = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda i: F.size(F.filter("found", lambda x: x["kind"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{RULES[i].name}") for i in base],
        F.sha2(shown(F.filter("found", lambda x: x["kind"] < len(base))), 256).alias("base_sha256"),
        shown(F.col("found")).alias("spans"),
    )

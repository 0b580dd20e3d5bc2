"""Secret scans with an incremental blob ledger. DataFrame functions only.

Every version of every path is named by the SHA-256 of its text. The ledger holds, per blob, which rules in which
versions have seen it and what they found. A scan reads only blobs that some (rule, version) has not seen, runs
just those rules, adds one increment to the ledger, and joins findings back to all paths that have the blob.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ledgerlake.llm.common import stored
from ledgerlake.plans.scratch import new_folder


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern` whose `group` has at least `least` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three base rules, in the order of the contract. Where every shorter match is dropped anyway and
#: cannot hide a longer one, the least length stands in the pattern.
BASE = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}+"),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{24,}+"),
)
#: The method's own: private keys to the line that ends them, or, where there is none, to the end of their letters.
#: Repetitions are bounded, as the regular expressions of the JVM take stack for each.
MORE = (
    Rule(
        "pem", 2,
        r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"
        r"(?:[^-]*+(?:-(?!----)[^-]*+){0,200}-----END (?:[A-Z]+ )*PRIVATE KEY-----|(?:\s{0,8}[A-Za-z0-9+/=]{16,}+){0,400})",
    ),
)
RULES = BASE + MORE

#: As the ledger keeps them, and as a scan gives them; rank is the place of the rule in the rules asked for.
FOUND = "array<struct<begin:int,rule:string,finish:int>>"
SPANS = "array<struct<begin:int,rank:int,kind:string,finish:int>>"
LEDGER = f"blob binary, rules array<string>, spans {FOUND}"


#: Elements of an array that are put together at once: what is built grows by copying.
_PART = 128


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, merge: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """For each element of an array of ints, all up to it merged; merge(0, x) must be x.

    Parts of _PART elements are worked out each on their own and then moved on by those before them, on `levels`
    levels, so that the work is in proportion to the array and not to its square.
    """
    none = F.array().cast("array<int>")

    def step(acc: Column, x: Column) -> Column:
        at = merge(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

    def whole(some: Column) -> Column:
        return F.aggregate(some, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def in_parts(some: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(some) - 1) / _PART).cast("int"))
        return F.transform(numbers, lambda k: whole(F.slice(some, k * _PART + 1, F.lit(_PART))))

    def moved(inner: Column) -> Column:
        lasts = F.transform(inner, lambda part: F.element_at(part, -1))
        return bound(running(lasts, merge, levels - 1), lambda before: F.flatten(F.transform(
            inner, lambda part, k: bound(F.coalesce(F.get(before, k - 1), F.lit(0)), lambda at: F.transform(part, lambda x: merge(at, x)))
        )))

    if not levels:
        return whole(values)
    return bound(values, lambda some: F.when(F.size(some) > _PART, bound(in_parts(some), moved)).otherwise(whole(some)))


def _spans(rule: Rule, text: Column) -> Column:
    """Spans of one rule: what lies between matches, and the matches, give the places in code points."""
    pattern = F.lit(rule.pattern)
    lengths = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, pattern, 0), F.length)
    value = F.transform(F.regexp_extract_all(text, pattern, rule.group), F.length) if rule.group else whole

    def placed(whole: Column) -> Column:
        finish = running(F.zip_with(F.slice(lengths, 1, F.size(whole)), whole, lambda gap, n: gap + n), lambda a, b: a + b)
        return F.arrays_zip(whole.alias("whole"), (value if rule.group else whole).alias("value"), finish.alias("finish"))

    found = F.filter(bound(whole, placed), lambda m: m["value"] >= rule.least)
    named = F.transform(found, lambda m: F.struct((m["finish"] - m["whole"]).alias("begin"), F.lit(rule.name).alias("rule"), m["finish"].alias("finish")))
    return F.when(F.regexp_like(text, pattern), named.cast(FOUND)).otherwise(F.array().cast(FOUND))


def _scanned(text: Column, rules: tuple[Rule, ...], todo: Column) -> Column:
    """Spans of the rules named in todo."""
    none = F.array().cast(FOUND)
    return F.concat(*(F.when(F.array_contains(todo, r.name), _spans(r, text)).otherwise(none) for r in rules))


def _ranked(found: Column, rules: tuple[Rule, ...]) -> Column:
    """Spans of the given rules among those found, by begin and then by the order of the rules."""
    names = F.array(*(F.lit(r.name) for r in rules))
    own = F.filter(found, lambda s: F.array_contains(names, s["rule"]))
    ranked = F.transform(own, lambda s: F.struct(
        s["begin"].alias("begin"), (F.array_position(names, s["rule"]) - 1).cast("int").alias("rank"),
        F.substring_index(s["rule"], "@", 1).alias("kind"), s["finish"].alias("finish"),
    ))
    return F.array_sort(ranked)


def spans_of(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text that is not null, without a ledger."""
    return _ranked(F.concat(*(_spans(r, text) for r in rules)), rules)


def ledger_of(spark: SparkSession, folder: str) -> DataFrame | None:
    """All increments of a ledger, or None if there is none yet."""
    try:
        return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(folder)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def named_versions(versions: DataFrame) -> DataFrame:
    """versions(path, text) with blob, the SHA-256 of the text's UTF-8; null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    return versions.select("path", text.alias("text")).select("path", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("blob"), "text")


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text, todo): each blob once, with the names of the rules that have not seen it; copies go before the shuffle."""
    names = F.array(*(F.lit(r.name) for r in rules))
    blobs = named_versions(versions).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        return blobs.withColumn("todo", names)
    seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    todo = F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", "text", todo.alias("todo")).where(F.size("todo") > 0)


def scan_blobs(versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add an increment to the ledger in folder for what versions(path, text) have unseen; the whole ledger."""
    spark = versions.sparkSession
    fresh = unseen(versions, ledger_of(spark, folder), rules)
    increment = fresh.select("blob", F.col("todo").alias("rules"), _scanned(F.col("text"), rules, F.col("todo")).alias("spans"))
    increment.write.parquet(f"{folder}/increment-{uuid.uuid4().hex}")
    return ledger_of(spark, folder)


def scan(versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, spans): findings of all versions(path, text), after one more increment of the ledger in folder.

    A path comes once for each of its versions. Of several versions of a rule in the ledger only those in `rules`
    count, and what two increments both found counts once. Null texts are empty, repeated rows repeat, no rows give no
    rows; a text without a find has no spans. Very long texts are scanned whole, in time proportional to their finds.
    """
    ledger = scan_blobs(versions, folder, rules)
    found = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    found = stored(found.select("blob", _ranked(F.col("spans"), rules).alias("spans")), "findings")
    return named_versions(versions).select("path", "blob").join(found, "blob").select("path", "spans")


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["finish"].cast("string"))), ",")


#: Code points times finds up to which pieces are cut from the text itself, which is read from its beginning each time.
_CUTS = 400_000_000


def masked(text: Column, spans: Column) -> Column:
    """The text with every span, overlaps once, replaced by its kind in brackets."""

    def pieces(reached: Column, cut: Callable[[Column, Column], Column]) -> Column:
        def piece(s: Column, k: Column) -> Column:
            at = F.coalesce(F.get(reached, k - 1), F.lit(0))
            mark = F.when(s["begin"] >= at, F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
            return F.concat(cut(at, F.greatest(s["begin"] - at, F.lit(0))), mark)

        end = F.element_at(reached, -1)
        return F.array_join(F.concat(F.transform(spans, piece), F.array(cut(end, F.length(text) - end))), "")

    def by_letter(reached: Column) -> Column:
        return bound(F.split(text, ""), lambda letters: pieces(reached, lambda at, n: F.array_join(F.slice(letters, at + 1, n), "")))

    def changed(reached: Column) -> Column:
        work = F.length(text).cast("bigint") * F.size(spans)
        return F.when(work <= _CUTS, pieces(reached, lambda at, n: text.substr(at + 1, n))).otherwise(by_letter(reached))

    reached = running(F.transform(spans, lambda s: s["finish"]), F.greatest)
    return F.when(F.size(spans) == 0, text).otherwise(bound(reached, changed))


def op4_secrets(documents: DataFrame) -> DataFrame:
    """The contract's counts and digests, by one increment on an empty ledger; each document is one version of its path."""
    versions = documents.select(F.col("doc_id").cast("bigint").alias("path"), "text")
    found = scan(versions, new_folder(documents.sparkSession, "blob-ledger"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        F.col("path").alias("doc_id"), *(count(r.kind) for r in BASE),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


def redacted(documents: DataFrame) -> DataFrame:
    """All rows of documents with their secrets masked in text, and n_chars, if there is one, counted again.

    A null text stays null. The ledger names each row by its blob, so the text itself is joined with the findings.
    """
    names = documents.columns
    versions = documents.select(F.lit(0).alias("path"), "text")
    folder = new_folder(documents.sparkSession, "blob-ledger")
    scan_blobs(versions, folder)
    ledger = ledger_of(documents.sparkSession, folder).where(F.size("spans") > 0)
    found = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    found = stored(found.select("blob", _ranked(F.col("spans"), RULES).alias("_spans")), "redactions")
    named = documents.toDF(*(f"_d{k}" for k in range(len(names))))
    text = F.col(f"_d{names.index('text')}")
    blob = F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))
    joined = named.withColumn("_blob", blob).join(found, F.col("_blob") == found.blob, "left")
    clean = F.when(F.col("_spans").isNull(), text).otherwise(masked(text, F.col("_spans")))
    rows = joined.withColumn(f"_d{names.index('text')}", clean)
    if "n_chars" in names:
        changed = F.when(F.col("_spans").isNotNull(), F.length(text).cast("bigint")).otherwise(F.col(f"_d{names.index('n_chars')}"))
        rows = rows.withColumn(f"_d{names.index('n_chars')}", changed)
    return rows.select(*(F.col(f"_d{k}").alias(c) for k, c in enumerate(names)))

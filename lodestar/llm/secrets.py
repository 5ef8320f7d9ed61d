"""Secret scans over a content-addressed blob ledger, DataFrame functions only.

Every version of every path is reduced to the SHA-256 of its content. The ledger, an append-only table of
(blob, rules, findings), says which rule versions have seen which blob and what each found; only unseen pairs are
scanned, each distinct blob once, and the findings of the rule versions asked for are joined back to all paths that
hold the blob. An append that is repeated after a failure does no harm, for equal entries count once.

Defined results: a null content is the empty text; empty texts have no findings; repeated rows each get their
own result row; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern are taken leftmost and non-overlapping, then kept if `group` is long enough."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")

#: A run of 24 hexadecimal digits or more is the same as a run of any length kept if it is that long; so for access keys.
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Formats published by the services that issue them.
MORE = (
    Rule("pem", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url", r"[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20/:@]+:[^\x00-\x20/:@]{3,}@"),
)
RULES = BASE + MORE
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,rule:string>>"


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule in code points. Between the gaps of a split lie the matches, so lengths add up to positions."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda s: F.length(s))
    hits = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda s: F.length(s))
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda s: F.length(s)) if rule.group else hits
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), sizes.alias("size"))
    found = F.aggregate(
        zipped,
        F.struct(F.lit(0).alias("at"), F.lit(None).cast(SPAN).alias("got")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["hit"]).alias("at"),
            F.when(
                x["size"] >= rule.least,
                F.concat(
                    F.coalesce(acc["got"], F.array().cast(SPAN)),
                    F.array(F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(rank).alias("rank"), (acc["at"] + x["gap"] + x["hit"]).alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rule.key).alias("rule"))),
                ),
            ).otherwise(acc["got"]).alias("got"),
        ),
        lambda acc: acc["got"],
    )
    return F.coalesce(F.when(F.regexp_like(text, pattern), found), F.array().cast(SPAN))


def blob_id(content: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(content), F.lit("")), 256))


def unseen(versions: DataFrame, content: str, rules: tuple[Rule, ...], ledger: DataFrame | None = None) -> DataFrame:
    """(blob, rules, findings) of each blob that the ledger lacks under some of the rules, for those rules."""
    fresh = versions.select(blob_id(content).alias("blob"), F.coalesce(F.col(content), F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    every = F.array(*(F.lit(r.key) for r in rules))
    due = every
    if ledger is not None:
        seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        fresh = fresh.join(seen, "blob", "left")
        due = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    fresh = fresh.select("blob", "text", due.alias("rules")).where(F.size("rules") > 0)
    take = lambda r, i: F.when(F.array_contains("rules", r.key), spans(F.col("text"), r, i)).otherwise(F.array().cast(SPAN))
    return fresh.select("blob", "rules", F.concat(*(take(r, i) for i, r in enumerate(rules))).alias("findings"))


def report(versions: DataFrame, path: str, content: str, book: DataFrame, scratch: Scratch, rules: tuple[Rule, ...]) -> DataFrame:
    """(path, blob, findings) for each row of versions; what the book has of these rule versions, by start, then by order of the rules."""
    ranks = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))))
    current = book.where(F.size("findings") > 0).groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("findings"))
    again = F.transform("findings", lambda x: F.struct(x["start"].alias("start"), ranks[x["rule"]].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"), x["rule"].alias("rule")))
    mine = F.array_sort(F.array_distinct(F.filter(again, lambda x: x["rank"].isNotNull())))
    found = scratch.save(current.select("blob", mine.alias("findings")).where(F.size("findings") > 0), "findings")
    # Both sides are read anew, so adaptive execution may split the rows of a blob that very many paths share.
    paths = versions.select(F.col(path).alias("path"), blob_id(content).alias("blob"))
    return paths.join(found, "blob", "left").select("path", "blob", F.coalesce("findings", F.array().cast(SPAN)).alias("findings"))


def scan(versions: DataFrame, path: str, content: str, scratch: Scratch, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, ledger_path: str | None = None) -> DataFrame:
    """(path, blob, findings) for each row of versions, scanning only (blob, rule version) pairs that the ledger lacks.

    ledger holds (blob, rules, findings) of earlier scans. New rows are appended to ledger_path, or else kept in
    scratch for this call only.
    """
    new = unseen(versions, content, rules, ledger)
    if ledger_path:
        new.write.mode("append").parquet(ledger_path)
        book = versions.sparkSession.read.schema(new.schema).parquet(ledger_path)
    else:
        book = scratch.save(new, "fresh")
        book = book.unionByName(ledger.select(*book.columns)) if ledger is not None else book
    return report(versions, path, content, book, scratch, rules)


def joined(found: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scratch = Scratch(spark)
    # The base rules first, as a scan before the others were published; then every blob is due for the others alone.
    book = scratch.save(unseen(docs, "text", BASE), "ledger")
    found = scan(docs, "doc_id", "text", scratch, ledger=book)
    number = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("findings", lambda x: x["kind"].isin(*(r.kind for r in BASE)))
    return found.select(
        F.col("path").alias("doc_id"),
        *(number(r.kind).alias(f"n_{r.kind}") for r in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
    )


def _oracle() -> str:
    """The same by DuckDB: split and extract, then positions from running lengths."""
    def one(i: int, r: Rule) -> str:
        p = r.pattern.replace("'", "''")
        return f"""
  SELECT doc_id, {i} AS rank, '{r.kind}' AS kind, unnest(list_transform(range(1, len(h) + 1), lambda k: {{'a': s[k] + q[k], 'b': s[k] + q[k] + length(h[k]), 'n': length(v[k])}})) AS f
  FROM (SELECT doc_id, h, v, list_transform(range(1, len(h) + 1), lambda k: coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0)::BIGINT) AS s,
               list_transform(range(1, len(h) + 1), lambda k: coalesce(list_sum(list_transform(h[1:k - 1], lambda x: length(x))), 0)::BIGINT) AS q
        FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '{p}') AS g, regexp_extract_all(coalesce(text, ''), '{p}') AS h,
                     regexp_extract_all(coalesce(text, ''), '{p}', {r.group}) AS v FROM documents WHERE regexp_matches(coalesce(text, ''), '{p}')))"""
    parts = "\n  UNION ALL".join(one(i, r) for i, r in enumerate(RULES))
    least = " ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in RULES)
    n_base = len(BASE)
    return f"""
WITH f AS ({parts}), k AS (SELECT doc_id, rank, kind, f.a AS a, f.b AS b FROM f WHERE f.n >= CASE kind {least} END),
j AS (SELECT doc_id, {', '.join(f"count(*) FILTER (rank = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))},
  coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (rank < {n_base}), '') AS base,
  coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank), '') AS spans FROM k GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}' for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN j USING (doc_id)"""


ORACLE = {"op1_secret_scan": _oracle()}

"""Work on file text: cleaning, chunks, secret scans and code checks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.columns import strip_ws
from ..session import written


def strip_comment_lines(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), strip_ws)
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(//|/\*|\*)")), "\n")


def compact(text: Column) -> Column:
    """Without comments and with white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"//[^\n\r]*", "")
    return strip_ws(F.regexp_replace(bare, r"\s+", " "))


def compact_source(
    contents: DataFrame, ranks: DataFrame | None = None, k: int | None = None, chars: int | None = None,
) -> DataFrame:
    """One headed, compacted text per file; with ``ranks`` and ``k`` only the best files, with
    ``chars`` only the head of each. Whole texts of all files by default."""
    text = compact(F.col("content"))
    if chars is not None:
        text = F.substring(text, 1, chars)
    rows = contents
    if k is not None:
        order = Window.partitionBy("repo_id").orderBy(F.desc(F.coalesce("score", F.lit(0))), "path")
        best = (
            contents.select("repo_id", "path").join(ranks, ["repo_id", "path"], "left")
            .withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k).select("repo_id", "path")
        )
        rows = contents.join(best, ["repo_id", "path"], "left_semi")
    return rows.select("repo_id", "path", F.concat(
        F.lit("=== "), "path", F.lit(" ===\n"), text).alias("context"))


def chunk_text(contents: DataFrame, max_size: int = 1000) -> DataFrame:
    """(repo_id, path, chunk_no, content): lines packed greedily, a chunk closes before it would
    pass ``max_size``; the closing chunk is kept only when it is not blank."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def add(acc: Column, line: Column) -> Column:
        full = F.length(acc["cur"]) + F.length(line) > max_size
        text = F.concat(line, F.lit("\n"))
        return F.when(full, F.struct(
            F.concat(acc["done"], F.array(acc["cur"])).alias("done"), text.alias("cur"))
        ).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["cur"], text).alias("cur")))

    def close(acc: Column) -> Column:
        return F.when(acc["cur"].rlike(r"\S"), F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])

    chunks = F.aggregate(F.split("content", "\n"), empty, add, close)
    return contents.select("repo_id", "path", F.posexplode(chunks).alias("chunk_no", "content"))


# --- secrets ---------------------------------------------------------------------

def secret_alerts(text: Column) -> Column:
    """Names of the rules that match, as an array."""
    return F.array_compact(F.array(*[
        F.when(text.rlike(pattern), F.lit(name)) for name, pattern in fixed.SECRET_RULES]))


def scan_secrets_pr(pr_files: DataFrame, max_files: int | None = None, max_chars: int | None = None) -> DataFrame:
    """One alert per changed file with a finding; whole patches of all files by default."""
    rows = pr_files
    if max_files is not None:
        order = Window.partitionBy("repo_id", "pr_number").orderBy("path")
        rows = rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= max_files)
    patch = F.coalesce("patch", F.lit("Binary/large file."))
    if max_chars is not None:
        patch = F.substring(patch, 1, max_chars)
    return (
        rows.select("repo_id", "pr_number", "path", secret_alerts(patch).alias("found"))
        .filter(F.size("found") > 0)
        .select("repo_id", "pr_number", "path",
                F.concat(F.lit("CRITICAL ALERT in "), "path", F.lit(": "), F.array_join("found", ", ")).alias("alert"))
    )


def has_diff_tokens(diff: Column) -> Column:
    return diff.rlike("|".join(fixed.DIFF_TOKEN_PATTERNS))


def risk_override(pr_risk: DataFrame, alerts: DataFrame) -> DataFrame:
    """(repo_id, pr_number, risk_level): ``high`` for a pull request with any alert."""
    hit = alerts.select("repo_id", "pr_number").distinct().withColumn("hit", F.lit(True))
    return pr_risk.join(hit, ["repo_id", "pr_number"], "left").withColumn(
        "risk_level", F.when(F.col("hit"), "high").otherwise(F.col("risk_level"))).drop("hit")


def impact_rows(impacts: DataFrame, alerts: DataFrame) -> DataFrame:
    """Impact list with alerts put in front, the last alert first: order by ``is_impact, alert_path desc, ord``."""
    breach = alerts.select(
        "repo_id", "pr_number", F.lit(0).alias("is_impact"), F.col("path").alias("alert_path"), F.lit(0).alias("ord"),
        F.lit("SECURITY BREACH").alias("file"), F.col("alert").alias("impact"))
    return breach.unionByName(impacts.select(
        "repo_id", "pr_number", F.lit(1).alias("is_impact"), F.lit(None).cast("string").alias("alert_path"),
        "ord", "file", "impact"))


# --- code checks -------------------------------------------------------------------

FUNCTION_OPENER = r"\bfunction\b[^{]*\{\s*\z|=>\s*\{\s*\z"
# a statement that ends on its line, with or without a semicolon
TERMINATOR = r"^(return|throw|break|continue)\b(.*[^{(\[,+*/=&|?:<>.\s-])?\s*\z"
LOOP_OPENER = r"^(while\s*\(\s*(true|1)\s*\)|for\s*\(\s*;\s*;\s*\))\s*\{\s*\z"

BLOCK = (
    "struct<level:int,line:int,text:string,fn:boolean,ended:int,word:string,told:boolean,tries:boolean,leaves:boolean,"
    "awaits:int,async:boolean,loop:boolean,outer:string>")
FINDING = "struct<kind:int,line:int,at:int,text:string,word:string>"


def _lines(content: Column) -> Column:
    """The lines that are neither blank nor comment, with what the rules ask of each."""
    def braces(text: Column, mark: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))

    texts = F.transform(F.split(content, "\n"), lambda raw, i: F.struct((i + 1).alias("line"), strip_ws(raw).alias("text")))
    code = F.filter(texts, lambda x: (x["text"] != "") & ~x["text"].rlike(r"^(//|/\*|\*)"))

    def seen(x: Column) -> Column:
        text = x["text"]
        closing = text.startswith("}")
        fn = text.rlike(FUNCTION_OPENER)
        return F.struct(
            x["line"].alias("line"), text.alias("text"), (braces(text, "{") - braces(text, "}")).alias("net"),
            F.length(F.regexp_extract(text, r"^(\}+)", 1)).alias("leading"), (~closing).alias("statement"), fn.alias("fn"),
            (fn & ~closing & text.rlike(r"\basync\b")).alias("async"), (~closing & text.rlike(LOOP_OPENER)).alias("loop"),
            text.rlike(TERMINATOR).alias("ends"), F.regexp_extract(text, r"^(\w+)", 1).alias("word"),
            text.rlike(r"\bawait\b").cast("int").alias("awaits"))

    return F.transform(code, seen)


def _one(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _step(state: Column, x: Column) -> Column:
    """The state after one line: depth, awaits so far, the stack of open blocks, findings."""
    none = F.array().cast(f"array<{FINDING}>")

    def told(kind: int, line: Column, at: Column, text: Column, word: Column) -> Column:
        return F.array(F.struct(F.lit(kind).alias("kind"), line.alias("line"), at.alias("at"), text.alias("text"), word.alias("word")))

    def after(level: Column) -> Column:
        awaits = state["awaits"] + x["awaits"]
        closed = F.filter(state["open"], lambda b: b["level"] >= level)
        found = F.flatten(F.transform(closed, lambda b: F.concat(
            F.when(b["async"] & (awaits > b["awaits"]) & ~b["tries"], told(1, b["line"], b["line"], b["text"], b["word"])).otherwise(none),
            F.when(b["loop"] & ~b["leaves"], told(2, b["line"], b["line"], b["outer"], b["word"])).otherwise(none))))
        kept = F.filter(state["open"], lambda b: b["level"] < level)
        return _one(F.struct(kept.alias("kept"), found.alias("found")), lambda s: _one(
            F.when(F.get(s["kept"], F.size(s["kept"]) - 1)["level"] == level - 1, F.get(s["kept"], F.size(s["kept"]) - 1)),
            lambda block: placed(level, awaits, s["kept"], s["found"], block)))

    def placed(level: Column, awaits: Column, kept: Column, found: Column, block: Column) -> Column:
        inside = x["statement"] & block.isNotNull()
        in_function = F.coalesce(inside & block["fn"], F.lit(False))
        dead = in_function & (block["ended"] > 0) & ~block["told"]
        stops = in_function & (block["ended"] == 0) & x["ends"]
        changed = F.struct(
            block["level"].alias("level"), block["line"].alias("line"), block["text"].alias("text"), block["fn"].alias("fn"),
            F.when(stops, x["line"]).otherwise(block["ended"]).alias("ended"), F.when(stops, x["word"]).otherwise(block["word"]).alias("word"),
            (block["told"] | dead).alias("told"), (block["tries"] | (in_function & (x["word"] == "try"))).alias("tries"),
            (block["leaves"] | x["word"].isin("break", "return")).alias("leaves"), block["awaits"].alias("awaits"),
            block["async"].alias("async"), block["loop"].alias("loop"), block["outer"].alias("outer"))
        stack = F.when(inside, F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(changed))).otherwise(kept)
        new = F.struct(
            level.alias("level"), x["line"].alias("line"), x["text"].alias("text"), x["fn"].alias("fn"), F.lit(0).alias("ended"),
            x["word"].alias("word"), F.lit(False).alias("told"), F.lit(False).alias("tries"), F.lit(False).alias("leaves"),
            awaits.alias("awaits"), x["async"].alias("async"), (in_function & x["loop"]).alias("loop"), block["text"].alias("outer"))
        opens = x["net"] + x["leading"] > 0
        return F.struct(
            (state["depth"] + x["net"]).alias("depth"), awaits.alias("awaits"),
            F.when(opens, F.concat(stack, F.array(new))).otherwise(stack).alias("open"),
            F.concat(state["found"], found, F.when(dead, told(0, x["line"], block["ended"], block["text"], block["word"])).otherwise(none)).alias("found"))

    return _one(state["depth"] - x["leading"], after)


def lint_code_lines(contents: DataFrame) -> DataFrame:
    """Findings (repo_id, path, type, function_name, line, description, severity).

    Token rules over lines: a statement right after a terminator in a function body (first per function), an async
    function that awaits without a ``try`` in its body, an endless loop in a function body without a direct ``break``
    or ``return``. Blocks are found by brace depth, so braces inside string literals and one-line functions are not
    seen. A file's lines are folded once inside its row with the stack of open blocks as state; nothing is exchanged.
    """
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("awaits"), F.array().cast(f"array<{BLOCK}>").alias("open"),
        F.array().cast(f"array<{FINDING}>").alias("found"))

    def finish(state: Column) -> Column:
        # loops of blocks that are never closed
        left = F.filter(state["open"], lambda b: b["loop"] & ~b["leaves"])
        return F.concat(state["found"], F.transform(left, lambda b: F.struct(
            F.lit(2).alias("kind"), b["line"].alias("line"), b["line"].alias("at"), b["outer"].alias("text"), b["word"].alias("word"))))

    found = contents.select("repo_id", "path", F.inline(F.aggregate(_lines(F.col("content")), start, _step, finish)))
    name = F.nullif(F.regexp_extract("text", r"\bfunction\b\s*\*?\s*([A-Za-z_$][\w$]*)", 1), F.lit(""))
    word, kind = F.col("word"), F.col("kind")
    statement = (
        F.when(word == "return", "ReturnStatement").when(word == "throw", "ThrowStatement")
        .when(word == "break", "BreakStatement").otherwise("ContinueStatement"))
    description = (
        F.when(kind == 0, F.concat(F.lit("Unreachable statement after "), statement, F.lit(" at line "), "at"))
        .when(kind == 1, F.concat(F.lit("Async function '"), F.coalesce(name, F.lit("(anonymous)")), F.lit("' uses await without try/catch")))
        .otherwise(F.concat(F.when(word == "while", "while(true)").otherwise("for(;;)"),
                            F.lit(" loop without break/return — potential infinite loop"))))
    types = F.array(*[F.lit(x) for x in ("unreachable_code", "missing_error_handling", "infinite_loop_candidate")])
    return found.select(
        "repo_id", "path", F.get(types, kind).alias("type"), name.alias("function_name"), "line", description.alias("description"),
        F.when(kind == 0, "error").otherwise("warning").alias("severity"))


def lint_top_files(contents: DataFrame, ranks: DataFrame, k: int = 5) -> DataFrame:
    """Findings of the ``k`` best-ranked script files of every repository."""
    order = Window.partitionBy("repo_id").orderBy(F.desc("score"), "path")
    best = (
        contents.filter(F.regexp_extract("path", r"(\.[^.]*)\z", 1).isin(".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"))
        .select("repo_id", "path").join(ranks.select("repo_id", "path", "score"), ["repo_id", "path"], "left")
        .withColumn("score", F.coalesce("score", F.lit(0)))
        .withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k).select("repo_id", "path")
    )
    return lint_code_lines(contents.join(best, ["repo_id", "path"], "left_semi"))


def findings_summary(findings: DataFrame) -> DataFrame:
    """Report lines per file: a heading (line 0), then one line per finding in line order.

    Headings and lines both read the findings, which are written once: texts are not checked twice.
    """
    findings = written(findings.select("repo_id", "path", "line", "severity", "description"), "findings")
    heads = findings.select("repo_id", "path").distinct().select(
        "repo_id", "path", F.lit(0).alias("line"), F.concat(F.lit("["), "path", F.lit("]")).alias("text"))
    body = findings.select(
        "repo_id", "path", "line",
        F.concat(F.lit("  "), F.when(F.col("severity") == "error", "ERROR").otherwise("WARN"), F.lit(" L"), "line",
                 F.lit(": "), "description").alias("text"))
    return heads.unionByName(body)

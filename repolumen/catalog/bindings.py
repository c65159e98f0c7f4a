"""Binds the star-schema test tables to the repository model.

For every table there is a Spark function and an SQL text that states the same rows, so the
checks of the operators start from equal inputs. All rows derive from the given tables.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import is_landed, land

_LANDED: dict[tuple, tuple] = {}


class Tables:
    """The test tables of one folder, and the model tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def landed(self, name: str, build) -> DataFrame:
        """Written once per application, as the sources of a repository are landed once for many queries."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _LANDED or not is_landed(self.spark, _LANDED[key][0]):  # new, or the folder was cleared
            df = build()
            _LANDED[key] = (land(df, name), df.schema)
        path, schema = _LANDED[key]
        return self.spark.read.schema(schema).parquet(path)

    # -- graphs ---------------------------------------------------------------
    def trade_edges(self) -> DataFrame:
        """Customer nation → supplier nation, weighted by their line items."""
        sup = self.raw("supplier").select("s_suppkey", "s_nationkey")
        flows = (
            self.raw("lineitem").select("l_orderkey", F.col("l_suppkey").alias("s_suppkey"))
            .join(self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
            .join(self.raw("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
            .join(sup, "s_suppkey").groupBy(F.col("c_nationkey").alias("s"), F.col("s_nationkey").alias("d"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        return flows.select(
            F.lit("trade").alias("repo_id"), F.concat(F.lit("n"), "s").alias("src"),
            F.concat(F.lit("n"), "d").alias("dst"), F.col("n").cast("double").alias("weight"))

    def trade_nodes(self) -> DataFrame:
        return self.raw("nation").select(F.lit("trade").alias("repo_id"), F.concat(F.lit("n"), "n_nationkey").alias("path"))

    def forest_edges(self) -> DataFrame:
        """customer → nation → region and supplier → nation; one repository per region."""
        nation = self.raw("nation").select("n_nationkey", "n_regionkey")
        repo = F.concat(F.lit("region"), "n_regionkey")

        def down(table: str, key: str, nkey: str, mark: str) -> DataFrame:
            return self.raw(table).select(key, F.col(nkey).alias("n_nationkey")).join(nation, "n_nationkey").select(
                repo.alias("repo_id"), F.concat(F.lit(mark), key).alias("src"), F.concat(F.lit("n:"), "n_nationkey").alias("dst"))

        up = nation.select(repo.alias("repo_id"), F.concat(F.lit("n:"), "n_nationkey").alias("src"),
                           F.concat(F.lit("r:"), "n_regionkey").alias("dst"))
        return (down("customer", "c_custkey", "c_nationkey", "c:")
                .unionByName(down("supplier", "s_suppkey", "s_nationkey", "s:")).unionByName(up))

    def successor_edges(self) -> DataFrame:
        """Supplier of a line → supplier of the next line of the order, weighted by how often; landed once per application."""
        line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")

        def build():
            pairs = (
                self.raw("lineitem").select("l_orderkey", F.col("l_suppkey").alias("s"), F.lead("l_suppkey").over(line).alias("d"))
                .filter(F.col("d").isNotNull() & (F.col("s") != F.col("d")))
                .groupBy("s", "d").agg(F.count(F.lit(1)).alias("weight"))
            )
            return pairs.select(F.lit("next").alias("repo_id"), F.concat(F.lit("s"), "s").alias("src"),
                                F.concat(F.lit("s"), "d").alias("dst"), F.col("weight").cast("double").alias("weight"))

        return self.landed("successor", build)

    # -- histories --------------------------------------------------------------
    def commit_rows(self) -> DataFrame:
        """An order is a commit, the suppliers of its lines are its files; four repositories by customer."""
        return (
            self.raw("lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
            .join(self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate"), "l_orderkey")
            .groupBy("l_orderkey", "l_suppkey", "o_custkey", "o_orderdate")
            .agg(F.min(F.when(F.col("l_returnflag") == "R", "removed").otherwise("modified")).alias("status"))
            .select(F.concat(F.lit("repo"), F.col("o_custkey") % 4).alias("repo_id"), F.concat(F.lit("o"), "l_orderkey").alias("sha"),
                    F.col("o_orderdate").alias("committed_at"), F.concat(F.lit("dev"), F.col("o_custkey") % 50).alias("author"),
                    F.concat(F.lit("f"), "l_suppkey").alias("path"), "status")
        )

    def history_edges(self) -> DataFrame:
        """Import edges between the files of the histories: the successor graph in every repository."""
        repos = self.raw("customer").select(F.concat(F.lit("repo"), F.col("c_custkey") % 4).alias("repo_id"),
                                            F.concat(F.lit("f"), F.col("c_custkey")).alias("src"))
        return repos.select("repo_id", "src", F.concat(F.lit("f"), F.substring("src", 2, 20).cast("bigint") + 1).alias("dst"))

    # -- files ---------------------------------------------------------------------
    def documents_as_files(self) -> DataFrame:
        """(repo_id, path, size, content) from documents: repository by language, six extensions."""
        ext = F.element_at(F.array(*[F.lit(e) for e in (".ts", ".tsx", ".js", ".py", ".md", ".html")]),
                           (F.col("doc_id") % 6 + 1).cast("int"))
        kind = (
            F.when(F.col("doc_id") % 11 == 3, "dist/").when(F.col("doc_id") % 13 == 5, "src/__tests__/")
            .when(F.col("doc_id") % 17 == 2, "lib/").when(F.col("doc_id") % 19 == 7, "examples/a/b/").otherwise(""))
        name = (
            F.when(F.col("doc_id") % 23 == 1, F.concat(F.lit("index"), ext))
            .when(F.col("doc_id") % 29 == 4, F.concat(F.lit("doc"), "doc_id", F.lit(".test"), ext))
            .when(F.col("doc_id") % 31 == 6, F.lit("package.json"))
            .when(F.col("doc_id") % 37 == 8, F.concat(F.lit("doc"), "doc_id", F.lit(".min.js")))
            .otherwise(F.concat(F.lit("doc"), "doc_id", ext)))
        path = F.concat(kind, "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id") % 7, F.lit("/"), name)
        return self.raw("documents").select(
            F.col("lang").alias("repo_id"),
            F.when(F.col("doc_id") % 41 == 9, F.concat(F.lit("main"), "doc_id", ext)).otherwise(path).alias("path"),
            F.col("n_chars").alias("size"), F.col("text").alias("content"), "doc_id")

    def files(self) -> DataFrame:
        return self.documents_as_files().groupBy("repo_id", "path").agg(F.max("size").alias("size"))

    def file_contents(self) -> DataFrame:
        """One content per path: that of the largest document id."""
        return self.documents_as_files().groupBy("repo_id", "path").agg(F.max_by("content", "doc_id").alias("content"))

    def modules(self) -> DataFrame:
        return self.landed("modules", self._module_sources)

    def _module_sources(self) -> DataFrame:
        """Source files (repo_id, path, content) written from orders, line items and suppliers.

        A supplier is a module that imports its successors; an order is a file that
        imports the suppliers of its lines in different notations and defines a function per line.
        """
        order_file = F.col("l_orderkey")
        is_page = order_file % 5 == 0
        up = F.when(is_page, "../../sup/").otherwise("../sup/")

        def text(line):
            """A line's text, written only after the numbers of its order have met: these are all that is shuffled."""
            number, p, q = line["l_linenumber"], line["l_partkey"], line["q"]
            supplier = F.concat(F.lit("s"), line["l_suppkey"])
            notation = (
                F.when(number % 6 == 0, F.concat(F.lit("import a from '"), up, supplier, F.lit("';")))
                .when(number % 6 == 1, F.concat(F.lit("import { b, c } from '@/sup/"), supplier, F.lit("';")))
                .when(number % 6 == 2, F.concat(F.lit('const d = require("'), up, supplier, F.lit('");')))
                .when(number % 6 == 3, F.concat(F.lit("export * from 'sup/"), supplier, F.lit("';")))
                .when(number % 6 == 4, F.concat(F.lit("import '~/sup/"), supplier, F.lit("';")))
                .otherwise(F.lit("import react from 'react';")))
            body = (
                F.when((q == 0) & (p % 2 == 0), F.concat(F.lit("function f"), p, F.lit("(x) {\n  return x\n  log(x)\n}")))
                .when(q == 0, F.concat(F.lit("function f"), p, F.lit("(x) {\n  return x;\n  log(x);\n}")))
                .when(q == 1, F.concat(F.lit("async function g"), p, F.lit("(x) {\n  const v = await load(x);\n  return v;\n}")))
                .when(q == 2, F.concat(F.lit("async function h"), p, F.lit("(x) {\n  try {\n    await load(x);\n  } catch (e) {\n    log(e);\n  }\n}")))
                .when(q == 3, F.concat(F.lit("function w"), p, F.lit("() {\n  while (true) {\n    step("), p, F.lit(");\n  }\n}")))
                .otherwise(F.concat(F.lit("// line "), p, F.lit("\nconst k"), p, F.lit(" = (x) => {\n  if (x) {\n    return x;\n  }\n  return 0;\n};"))))
            html = F.concat(F.lit('<script src="src/sup/'), supplier, F.lit('.ts"></script>\n<link rel="x" href="http://x/'), supplier, F.lit('.css">'))
            return F.when(order_file % 11 == 0, html).otherwise(F.concat(notation, F.lit("\n"), body))

        order_path = (
            F.when(order_file % 11 == 0, F.concat(F.lit("public/o"), order_file, F.lit(".html")))
            .when(is_page, F.concat(F.lit("src/app/o"), order_file, F.lit("/page.tsx")))
            .when(order_file % 7 == 0, F.concat(F.lit("src/orders/o"), order_file, F.lit(".test.ts")))
            .otherwise(F.concat(F.lit("src/orders/o"), order_file, F.lit(".ts"))))
        q = (F.col("l_quantity").cast("bigint") % 5).cast("tinyint").alias("q")
        lines = self.raw("lineitem").select("l_orderkey", F.struct("l_linenumber", "l_suppkey", "l_partkey", q).alias("line"))
        written = F.transform("lines", lambda x: F.struct(x["l_linenumber"], x["l_suppkey"], x["l_partkey"], text(x).alias("t")))
        of_orders = (
            # rows go to their order once and are not collected in part before, which would only sort and spill
            lines.repartition("l_orderkey").groupBy("l_orderkey").agg(F.collect_list("line").alias("lines"))
            .select(F.concat(F.lit("repo"), F.col("l_orderkey") % 3).alias("repo_id"), order_path.alias("path"),
                    F.array_join(F.transform(F.array_sort(written), lambda x: x["t"]), "\n").alias("content"))
        )
        o = F.col("o_orderkey")
        companion = (
            F.when(o % 10 == 0, F.concat(F.lit("src/app/o"), o, F.lit("/layout.tsx")))
            .when(o % 10 == 5, F.concat(F.lit("src/app/o"), o, F.lit("/loading.tsx")))
            .otherwise(F.concat(F.lit("src/orders/__tests__/o"), o, F.lit(".ts"))))
        companions = self.raw("orders").select(
            F.concat(F.lit("repo"), o % 3).alias("repo_id"), companion.alias("path"), F.lit("").alias("content"))
        key = F.col("s_suppkey")
        nxt = self.successor_edges().groupBy(F.substring("src", 2, 20).cast("bigint").alias("s_suppkey")).agg(
            F.array_join(F.array_sort(F.transform(F.collect_list("dst"), lambda d: F.concat(F.lit("import '@/sup/"), d, F.lit("';")))), "\n").alias("content"))
        sup_path = (
            F.when(key % 4 == 0, F.concat(F.lit("src/sup/s"), key, F.lit(".ts")))
            .when(key % 4 == 1, F.concat(F.lit("src/sup/s"), key, F.lit("/index.tsx")))
            .when(key % 4 == 2, F.concat(F.lit("src/sup/s"), key, F.lit(".js")))
            .otherwise(F.concat(F.lit("lib/sup/s"), key, F.lit(".mjs"))))
        of_suppliers = self.raw("supplier").select("s_suppkey").join(nxt, "s_suppkey", "left").select(
            F.concat(F.lit("repo"), key % 3).alias("repo_id"), sup_path.alias("path"), F.coalesce("content", F.lit("")).alias("content"))
        configs = self.raw("supplier").select(
            F.concat(F.lit("repo"), key % 3).alias("repo_id"), F.lit("tsconfig.json").alias("path"),
            F.lit(TSCONFIG).alias("content")).distinct()
        return of_orders.unionByName(companions).unionByName(of_suppliers).unionByName(configs)

    def module_files(self) -> DataFrame:
        return self.modules().select("repo_id", "path", F.length("content").cast("bigint").alias("size"))

    def alias_configs(self) -> DataFrame:
        """Configuration files with inheritance, one small repository per supplier."""
        key = F.col("s_suppkey")
        repo = F.concat(F.lit("cfg"), key)
        root = F.concat(F.lit('{ "extends": "./base'), key % 3, F.lit('.json", // own\n "compilerOptions": {"paths": {"@/*": ["app'), key % 5,
                        F.lit('/*"], "#u": ["util"]}} }'))
        base = F.concat(F.lit('{ "extends": "./deep.json", "compilerOptions": {"baseUrl": "./code", "paths": {"@/*": ["no/*"], "@/lib/*": ["./lib'),
                        key % 7, F.lit('/*"]}} }'))
        deep = F.concat(F.lit('{"compilerOptions": {"baseUrl": "zz", "paths": {"d'), key, F.lit('/*": ["deep/*"]}}}'))
        rows = F.array(
            F.struct(F.when(key % 10 == 0, "jsconfig.json").otherwise("tsconfig.json").alias("path"), root.alias("content")),
            F.struct(F.lit("base0.json").alias("path"), base.alias("content")),
            F.struct(F.lit("base1.json").alias("path"), base.alias("content")),
            F.struct(F.lit("deep.json").alias("path"), deep.alias("content")),
            F.struct(F.when(key % 4 == 0, "next.config.js").otherwise("other.js").alias("path"), F.lit("").alias("content")))
        return self.raw("supplier").select(repo.alias("repo_id"), F.inline(rows))

    # -- traces -------------------------------------------------------------------
    def traces(self) -> DataFrame:
        """A stack trace per event, with frames that name module files in several ways."""
        e = F.col("event_id")
        s = F.col("user_id") % 100 + 1
        head = (
            F.when(e % 6 == 0, F.concat(F.lit("TypeError: bad value "), "value"))
            .when(e % 6 == 1, F.lit("Uncaught AuthError: missing AUTH env"))
            .when(e % 6 == 2, F.lit("ReferenceError: x is not defined"))
            .when(e % 6 == 3, F.lit("  RangeError: connect ECONNREFUSED 10.0.0.1"))
            .when(e % 6 == 4, F.lit("something went wrong")).otherwise(F.lit("SyntaxError: Database Timeout")))
        frame = (
            F.when(e % 7 == 0, F.concat(F.lit("    at run (src/sup/s"), s, F.lit(".ts:12:5)")))
            .when(e % 7 == 1, F.concat(F.lit("    at async load (/srv/x/src/sup/s"), s, F.lit(".js:7:1)")))
            .when(e % 7 == 2, F.concat(F.lit("    at /deploy/sup/s"), s, F.lit(".mjs:3:9")))
            .when(e % 7 == 3, F.concat(F.lit("    at go (up/s"), s, F.lit(".ts:44:2)")))
            .when(e % 7 == 4, F.concat(F.lit("    at go (s"), s, F.lit("/index.tsx:9:2)")))
            .when(e % 7 == 5, F.concat(F.lit("    at go (x/y/s"), s, F.lit(".mjs:1:1)")))
            .otherwise(F.lit("    at go (index.tsx:9:2)")))
        trace = F.concat(head, F.lit("\n    at Object.<anonymous> (node_modules/a/b.js:1:1)\n"), frame,
                         F.lit("\n    at main (/srv/src/sup/s4.ts:2:2)"))
        return self.raw("events").select(
            F.concat(F.lit("t"), "event_id").alias("trace_id"), F.concat(F.lit("repo"), s % 3).alias("repo_id"), trace.alias("trace"))

    # -- pull requests --------------------------------------------------------------
    def pr_files(self) -> DataFrame:
        """Documents as patches: 37 pull requests per language."""
        d = F.col("doc_id")
        return self.raw("documents").select(
            F.col("lang").alias("repo_id"), (d % 37).alias("pr_number"), F.concat("source", F.lit("/doc"), d, F.lit(".ts")).alias("path"),
            F.when(d % 3 == 0, "added").otherwise("modified").alias("status"), (d % 50).cast("int").alias("additions"),
            (d % 80).cast("int").alias("changes"), F.when(d % 9 == 0, F.lit(None)).otherwise(F.col("text")).alias("patch"))

    def supplier_prs(self) -> DataFrame:
        """A day of orders is a pull request on the successor graph: it changes the suppliers of its lines."""
        day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("bigint")
        return (
            self.raw("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
            .join(self.raw("orders").select("o_orderkey", day.alias("pr_number")), "o_orderkey")
            .select(F.lit("next").alias("repo_id"), "pr_number", F.concat(F.lit("s"), "l_suppkey").alias("path")).distinct()
        )

    # -- operations --------------------------------------------------------------------
    def analyses(self) -> DataFrame:
        o, c = F.col("o_orderkey"), F.col("o_custkey")
        name = F.concat(F.lit("Org"), c % 7, F.lit("/repo"), c % 50)
        grade = F.substring("o_orderpriority", 1, 1)
        letter = F.translate(grade, "12345", "ABCDF")
        status = F.when(c % 50 % 8 == 3, F.lit("")).otherwise(F.concat(F.lit("State "), letter))
        body = F.when(o % 13 == 0, F.lit("{}")).otherwise(F.concat(
            F.lit('{"healthMetrics":{"grade":"'), letter, F.lit('","score":'), (o % 100).cast("string"),
            F.lit(',"status":"'), status, F.lit('"}}')))
        return self.raw("orders").select(
            o.alias("id"), F.concat(F.lit("https://github.com/"), name).alias("repo_url"), name.alias("repo_name"),
            F.concat(F.lit("sha"), o % 5).alias("commit_sha"), (o % 3 + 1).cast("int").alias("analysis_version"),
            F.when(c % 6 == 0, F.lit(None)).otherwise(F.concat(F.lit("u"), c % 40)).alias("user_id"),
            F.col("o_orderdate").alias("created_at"), body.alias("result_json"))

    def usage(self) -> DataFrame:
        kind = (F.when(F.col("event_type") == "purchase", "repo").when(F.col("event_type") == "click", "pr")
                .when(F.col("event_type") == "error", "debug").when(F.col("event_type") == "signup", "ai").otherwise("view"))
        return self.raw("events").select(F.concat(F.lit("u"), "user_id").alias("user_id"), kind.alias("kind"), "ts").filter("kind <> 'view'")

    def profiles(self) -> DataFrame:
        u = F.col("user_id")
        return self.raw("events").select("user_id").distinct().select(
            F.concat(F.lit("u"), u).alias("user_id"), F.when(u % 4 == 0, "pro").otherwise("free").alias("plan_tier"),
            (u % 25 == 0).alias("is_admin"))

    def sub_events(self) -> DataFrame:
        """Subscription events; every tenth event id is delivered under its predecessor's id."""
        e, t = F.col("event_id"), F.col("event_type")
        event = (F.when(t == "signup", "subscription.activated").when(t == "purchase", "subscription.updated")
                 .when(t == "error", "subscription.halted").when(t == "view", "subscription.cancelled").otherwise("payment.failed"))
        status = F.when(e % 3 == 0, "active").when(e % 3 == 1, "expired").otherwise("paused")
        return self.raw("events").select(
            F.concat(F.lit("e"), F.when(e % 10 == 9, e - 1).otherwise(e)).alias("event_id"), F.concat(F.lit("u"), "user_id").alias("user_id"),
            event.alias("event"), status.alias("status"), "ts")


TSCONFIG = '{\n  // aliases\n  "compilerOptions": { "paths": { "@/*": ["./src/*"], "~/*": ["./lib/*"] } }\n}'


# --- the same rows in SQL -------------------------------------------------------------

TRADE = """trade AS (
  SELECT 'trade' AS repo_id, 'n' || s AS src, 'n' || d AS dst, CAST(n AS DOUBLE) AS weight FROM (
    SELECT c_nationkey s, s_nationkey d, count(*) n FROM orders JOIN lineitem ON l_orderkey=o_orderkey
      JOIN customer ON c_custkey=o_custkey JOIN supplier ON s_suppkey=l_suppkey GROUP BY 1,2)),
trade_nodes AS (SELECT 'trade' AS repo_id, 'n' || n_nationkey AS path FROM nation)"""

FOREST = """forest AS (
  SELECT 'region' || n_regionkey AS repo_id, 'c:' || c_custkey AS src, 'n:' || n_nationkey AS dst FROM customer JOIN nation ON c_nationkey=n_nationkey
  UNION ALL SELECT 'region' || n_regionkey, 's:' || s_suppkey, 'n:' || n_nationkey FROM supplier JOIN nation ON s_nationkey=n_nationkey
  UNION ALL SELECT 'region' || n_regionkey, 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation)"""

SUCCESSOR = """successor AS (
  SELECT 'next' AS repo_id, 's' || s AS src, 's' || d AS dst, CAST(w AS DOUBLE) AS weight FROM (
    SELECT s, d, count(*) w FROM (SELECT l_suppkey s, lead(l_suppkey) OVER (
      PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) d FROM lineitem)
    WHERE d IS NOT NULL AND s <> d GROUP BY 1,2))"""

COMMITS = """commit_rows AS (
  SELECT 'repo' || (o_custkey % 4) AS repo_id, 'o' || l_orderkey AS sha, o_orderdate AS committed_at, 'dev' || (o_custkey % 50) AS author,
    'f' || l_suppkey AS path, min(CASE WHEN l_returnflag='R' THEN 'removed' ELSE 'modified' END) AS status
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY l_orderkey, l_suppkey, o_custkey, o_orderdate),
commit_ok AS (
  SELECT c.* FROM commit_rows c JOIN (SELECT repo_id, sha FROM commit_rows GROUP BY 1,2
    HAVING count(*) FILTER (WHERE status <> 'removed') >= 2) USING (repo_id, sha) WHERE status <> 'removed'),
history_edges AS (SELECT 'repo' || (c_custkey % 4) AS repo_id, 'f' || c_custkey AS src, 'f' || (c_custkey + 1) AS dst FROM customer)"""

DOC_FILES = """doc_files AS (
  SELECT lang AS repo_id, CASE WHEN doc_id % 41 = 9 THEN 'main' || doc_id || ext ELSE
    CASE WHEN doc_id % 11 = 3 THEN 'dist/' WHEN doc_id % 13 = 5 THEN 'src/__tests__/' WHEN doc_id % 17 = 2 THEN 'lib/'
      WHEN doc_id % 19 = 7 THEN 'examples/a/b/' ELSE '' END || source || '/' || lang || '/' || (doc_id % 7) || '/' ||
    CASE WHEN doc_id % 23 = 1 THEN 'index' || ext WHEN doc_id % 29 = 4 THEN 'doc' || doc_id || '.test' || ext
      WHEN doc_id % 31 = 6 THEN 'package.json' WHEN doc_id % 37 = 8 THEN 'doc' || doc_id || '.min.js' ELSE 'doc' || doc_id || ext END END AS path,
    n_chars AS size, text AS content, doc_id
  FROM (SELECT *, (['.ts','.tsx','.js','.py','.md','.html'])[doc_id % 6 + 1] AS ext FROM documents)),
files AS (SELECT repo_id, path, max(size) AS size FROM doc_files GROUP BY 1,2),
file_contents AS (SELECT repo_id, path, arg_max(content, doc_id) AS content FROM doc_files GROUP BY 1,2)"""

MODULES = SUCCESSOR + """,
order_text AS (
  SELECT l_orderkey o, l_linenumber ln, l_suppkey sk, l_partkey pk,
    CASE WHEN l_orderkey % 11 = 0 THEN '<script src="src/sup/s' || l_suppkey || '.ts"></script>' || chr(10) || '<link rel="x" href="http://x/s' || l_suppkey || '.css">'
    ELSE CASE l_linenumber % 6 WHEN 0 THEN 'import a from ''' || up || 's' || l_suppkey || ''';'
      WHEN 1 THEN 'import { b, c } from ''@/sup/s' || l_suppkey || ''';'
      WHEN 2 THEN 'const d = require("' || up || 's' || l_suppkey || '");'
      WHEN 3 THEN 'export * from ''sup/s' || l_suppkey || ''';'
      WHEN 4 THEN 'import ''~/sup/s' || l_suppkey || ''';' ELSE 'import react from ''react'';' END || chr(10) ||
      replace(CASE CAST(l_quantity AS BIGINT) % 5
        WHEN 0 THEN 'function f' || l_partkey || CASE WHEN l_partkey % 2 = 0 THEN '(x) {@  return x@  log(x)@}' ELSE '(x) {@  return x;@  log(x);@}' END
        WHEN 1 THEN 'async function g' || l_partkey || '(x) {@  const v = await load(x);@  return v;@}'
        WHEN 2 THEN 'async function h' || l_partkey || '(x) {@  try {@    await load(x);@  } catch (e) {@    log(e);@  }@}'
        WHEN 3 THEN 'function w' || l_partkey || '() {@  while (true) {@    step(' || l_partkey || ');@  }@}'
        ELSE '// line ' || l_partkey || '@const k' || l_partkey || ' = (x) => {@  if (x) {@    return x;@  }@  return 0;@};' END, '@', chr(10)) END AS t
  FROM (SELECT *, CASE WHEN l_orderkey % 5 = 0 THEN '../../sup/' ELSE '../sup/' END AS up FROM lineitem)),
modules AS (
  SELECT 'repo' || (o % 3) AS repo_id, CASE WHEN o % 11 = 0 THEN 'public/o' || o || '.html' WHEN o % 5 = 0 THEN 'src/app/o' || o || '/page.tsx'
      WHEN o % 7 = 0 THEN 'src/orders/o' || o || '.test.ts' ELSE 'src/orders/o' || o || '.ts' END AS path,
    string_agg(t, chr(10) ORDER BY ln, sk, pk, t) AS content FROM order_text GROUP BY o
  UNION ALL SELECT 'repo' || (o_orderkey % 3), CASE o_orderkey % 10 WHEN 0 THEN 'src/app/o' || o_orderkey || '/layout.tsx' WHEN 5 THEN 'src/app/o' || o_orderkey || '/loading.tsx'
      ELSE 'src/orders/__tests__/o' || o_orderkey || '.ts' END, '' FROM orders
  UNION ALL SELECT 'repo' || (s_suppkey % 3), CASE s_suppkey % 4 WHEN 0 THEN 'src/sup/s' || s_suppkey || '.ts' WHEN 1 THEN 'src/sup/s' || s_suppkey || '/index.tsx'
      WHEN 2 THEN 'src/sup/s' || s_suppkey || '.js' ELSE 'lib/sup/s' || s_suppkey || '.mjs' END,
    coalesce(content, '') FROM supplier LEFT JOIN (SELECT src, string_agg('import ''@/sup/' || dst || ''';', chr(10) ORDER BY 'import ''@/sup/' || dst || ''';') content
      FROM successor GROUP BY 1) ON src = 's' || s_suppkey
  UNION ALL SELECT DISTINCT 'repo' || (s_suppkey % 3), 'tsconfig.json', '""" + TSCONFIG.replace("\n", "' || chr(10) || '") + """' FROM supplier),
module_files AS (SELECT repo_id, path, CAST(length(content) AS BIGINT) AS size FROM modules)"""

TRACES = """traces AS (
  SELECT 't' || event_id AS trace_id, 'repo' || (s % 3) AS repo_id,
    CASE event_id % 6 WHEN 0 THEN 'TypeError: bad value ' || value WHEN 1 THEN 'Uncaught AuthError: missing AUTH env'
      WHEN 2 THEN 'ReferenceError: x is not defined' WHEN 3 THEN '  RangeError: connect ECONNREFUSED 10.0.0.1'
      WHEN 4 THEN 'something went wrong' ELSE 'SyntaxError: Database Timeout' END || chr(10) ||
    '    at Object.<anonymous> (node_modules/a/b.js:1:1)' || chr(10) ||
    CASE event_id % 7 WHEN 0 THEN '    at run (src/sup/s' || s || '.ts:12:5)' WHEN 1 THEN '    at async load (/srv/x/src/sup/s' || s || '.js:7:1)'
      WHEN 2 THEN '    at /deploy/sup/s' || s || '.mjs:3:9' WHEN 3 THEN '    at go (up/s' || s || '.ts:44:2)'
      WHEN 4 THEN '    at go (s' || s || '/index.tsx:9:2)' WHEN 5 THEN '    at go (x/y/s' || s || '.mjs:1:1)'
      ELSE '    at go (index.tsx:9:2)' END || chr(10) || '    at main (/srv/src/sup/s4.ts:2:2)' AS trace
  FROM (SELECT *, user_id % 100 + 1 AS s FROM events))"""

PRS = """prs AS (SELECT DISTINCT 'next' AS repo_id, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS pr_number, 's' || l_suppkey AS path
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
walk(repo_id, pr_number, path) AS (SELECT * FROM prs UNION SELECT w.repo_id, w.pr_number, e.src FROM walk w JOIN successor e ON e.repo_id = w.repo_id AND e.dst = w.path),
classes AS (SELECT w.repo_id, w.pr_number, w.path, CASE WHEN p.path IS NULL THEN 'blast' ELSE 'modified' END AS class FROM walk w LEFT JOIN prs p USING (repo_id, pr_number, path))"""

PR_FILES = """pr_files AS (
  SELECT lang AS repo_id, doc_id % 37 AS pr_number, source || '/doc' || doc_id || '.ts' AS path,
    CASE WHEN doc_id % 3 = 0 THEN 'added' ELSE 'modified' END AS status, CAST(doc_id % 50 AS INTEGER) AS additions, CAST(doc_id % 80 AS INTEGER) AS changes,
    CASE WHEN doc_id % 9 = 0 THEN NULL ELSE text END AS patch FROM documents)"""

ANALYSES = """analyses AS (
  SELECT o_orderkey AS id, 'https://github.com/' || name AS repo_url, name AS repo_name, 'sha' || (o_orderkey % 5) AS commit_sha,
    CAST(o_orderkey % 3 + 1 AS INTEGER) AS analysis_version, CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE 'u' || (o_custkey % 40) END AS user_id,
    o_orderdate AS created_at, CASE WHEN o_orderkey % 13 = 0 THEN '{}' ELSE '{"healthMetrics":{"grade":"' || letter || '","score":' || (o_orderkey % 100) ||
      ',"status":"' || CASE WHEN o_custkey % 50 % 8 = 3 THEN '' ELSE 'State ' || letter END || '"}}' END AS result_json
  FROM (SELECT *, 'Org' || (o_custkey % 7) || '/repo' || (o_custkey % 50) AS name, translate(substr(o_orderpriority,1,1), '12345', 'ABCDF') AS letter FROM orders))"""

USAGE = """usage AS (SELECT 'u' || user_id AS user_id, CASE event_type WHEN 'purchase' THEN 'repo' WHEN 'click' THEN 'pr' WHEN 'error' THEN 'debug' ELSE 'ai' END AS kind, ts
  FROM events WHERE event_type IN ('purchase','click','error','signup')),
profiles AS (SELECT DISTINCT 'u' || user_id AS user_id, CASE WHEN user_id % 4 = 0 THEN 'pro' ELSE 'free' END AS plan_tier, user_id % 25 = 0 AS is_admin FROM events)"""

SUB_EVENTS = """sub_events AS (SELECT 'e' || CASE WHEN event_id % 10 = 9 THEN event_id - 1 ELSE event_id END AS event_id, 'u' || user_id AS user_id,
  CASE event_type WHEN 'signup' THEN 'subscription.activated' WHEN 'purchase' THEN 'subscription.updated' WHEN 'error' THEN 'subscription.halted'
    WHEN 'view' THEN 'subscription.cancelled' ELSE 'payment.failed' END AS event,
  CASE event_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'expired' ELSE 'paused' END AS status, ts FROM events)"""

ALIAS_CONFIGS = """cfg AS (SELECT s_suppkey AS k, 'cfg' || s_suppkey AS repo_id FROM supplier)"""

"""Facts of front-end source files as tables, read off by regular expressions and nesting regions inside Spark.

A file is a row (path, content). Imports, exports, hook calls, state pairs and effects become rows with their line; nothing
here builds a syntax tree: imports and exports are what their head line shows, hooks and states go by bracket pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators.graph import closure
from quillmesh.operators.resolution import expand_aliases
from quillmesh.sources.regions import by_file, matches, part, read_once, text_at

#: Hooks whose dependencies are read, and those that count as effects.
DEP_HOOKS = ["useEffect", "useLayoutEffect", "useMemo", "useCallback", "useImperativeHandle"]
EFFECT_HOOKS = ["useEffect", "useLayoutEffect"]
STATE_HOOKS = ["useState", "useReducer"]
#: Suffixes that a relative import may leave out, in the order they are tried.
SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
#: Files above this size, or without a trace of the framework in their first characters, are left out.
LARGEST, SNIFFED = 1 << 20, 2048
_REACT = r"""from\s+['"]react['"]|require\(['"]react['"]\)|\buse[A-Z]\w*\s*\(|React\."""


def scan(spark: SparkSession, folder: str, glob: str = "*.{ts,tsx,js,jsx}", ignore: str = r"/(node_modules|dist|build|coverage|\.git)/") -> DataFrame:
    """(path, content, modified, md5) of the files under a folder that ``ignore`` does not match."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    raw = raw.where((F.col("length") <= LARGEST) & ~F.col("path").rlike(ignore))
    return raw.select(F.regexp_replace("path", "^file:", "").alias("path"), F.col("content").cast("string").alias("content"), F.col("modificationTime").alias("modified"), F.md5("content").alias("md5"))


def likely_react(files: DataFrame) -> DataFrame:
    """Files worth reading: by extension, or by their first characters."""
    return files.where((F.length("content") <= LARGEST) & (F.col("path").rlike(r"\.[jt]sx$") | F.substring("content", 1, SNIFFED).rlike(_REACT)))


def _names(clause: Column) -> Column:
    """Local names of an import or dependency list."""
    parts = F.transform(F.split(clause, ","), lambda p: F.trim(F.regexp_replace(p, r"^\s*(?:type\s+)?(?:\S+\s+as\s+)?", "")))
    return F.filter(parts, lambda p: p != "")


def imports(files: DataFrame, relative: bool = True) -> DataFrame:
    """(path, source, names, is_default, is_namespace, line) of static imports, requires and dynamic imports, those with a
    relative source unless all are asked for."""
    static = matches(files, r"""\bimport\s+(?:type\s+)?([\w$*\s{},]+?)\s+from\s+['"]([^'"]+)['"]""", "clause", "source")
    inner = F.regexp_extract("clause", r"(?s)\{(.*)\}", 1)
    head = F.trim(F.regexp_extract("clause", r"^\s*([\w$]+)\s*(?:,|$)", 1))
    star = F.regexp_extract("clause", r"\*\s+as\s+([\w$]+)", 1)
    named = F.filter(F.concat(F.array(head, star), _names(inner)), lambda n: n != "")
    rows = static.select("path", "source", named.alias("names"), (head != "").alias("is_default"), (star != "").alias("is_namespace"), "line")
    other = matches(files, r"""\b(?:require|import)\s*\(\s*['"]([^'"]+)['"]\s*\)|\bimport\s+['"]([^'"]+)['"]""", "a", "b")
    other = other.select("path", F.when(F.col("a") != "", F.col("a")).otherwise(F.col("b")).alias("source"), F.array().cast("array<string>").alias("names"), F.lit(False).alias("is_default"), F.lit(False).alias("is_namespace"), "line")
    rows = rows.unionByName(other)
    return rows.where("source like '.%' or source like '/%'") if relative else rows


def renamed_imports(files: DataFrame) -> DataFrame:
    """(path, local, imported): names that an import gives another name in its file."""
    static = matches(files, r"""\bimport\s+(?:type\s+)?[\w$*\s,]*\{([\w$\s,]+)\}\s*from\s+['"][^'"]+['"]""", "clause")
    part = static.select("path", F.explode(F.regexp_extract_all("clause", F.lit(r"([\w$]+\s+as\s+[\w$]+)"), F.lit(1))).alias("part"))
    return part.select("path", F.regexp_extract("part", r"([\w$]+)$", 1).alias("local"), F.regexp_extract("part", r"^([\w$]+)", 1).alias("imported")).where("local != imported")


def exports(files: DataFrame) -> DataFrame:
    """(path, name, is_default, is_memoized, line): declarations, and the names that export lists give, those handed on from
    other files among them."""
    rows = matches(files, r"\bexport\s+(default\s+)?(?:async\s+)?(?:(?:const|let|var|function\*?|class)\s+)?([\w$]+)(\s*=\s*(?:React\.)?memo\s*\(|\s*\(|)", "d", "name", "tail")
    memo = F.col("tail").rlike("memo") | ((F.col("d") != "") & (F.col("name") == "memo"))
    declared = rows.where(~F.col("name").isin("from", "type", "interface", "enum")).select("path", "name", (F.col("d") != "").alias("is_default"), memo.alias("is_memoized"), "line")
    lists = matches(files, r"\bexport\s*\{([\w$\s,]*)\}", "clause").select("path", "line", F.explode(F.split("clause", ",")).alias("part")).where("trim(part) != '' and not trim(part) rlike '^type\\\\s'")
    name = F.regexp_extract("part", r"([\w$]+)\s*$", 1)
    return declared.unionByName(lists.select("path", name.alias("name"), (name == "default").alias("is_default"), F.lit(False).alias("is_memoized"), "line"))


def _pairs(tokens: str) -> Column:
    """(state, setter) of the pairs in a file's tokens, of equal state names the last one."""
    at = lambda t, k: text_at(tokens, t["at"] + k)
    made = lambda t: at(t, 6).isin(STATE_HOOKS) | ((at(t, 6) == "React") & at(t, 8).isin(STATE_HOOKS))
    heads = F.filter(tokens, lambda t: (t["text"] == "[") & (t["mate"] == t["at"] + 4) & (at(t, 2) == ",") & (at(t, 5) == "=") & made(t))
    pairs = F.transform(heads, lambda t: F.named_struct(F.lit("state"), at(t, 1), F.lit("setter"), at(t, 3), F.lit("line"), t["line"]))
    return F.filter(pairs, lambda p, k: ~F.exists(F.slice(pairs, k + 2, F.size(pairs)), lambda q: q["state"] == p["state"]))


def state_pairs(files: DataFrame) -> DataFrame:
    """(path, state, setter): of equal state names in a file the last one counts."""
    return by_file(read_once(files).select("files", F.explode(_pairs("tokens")).alias("p")).select("files", "p.state", "p.setter"))


def hook_calls(files: DataFrame) -> DataFrame:
    """(content, files, pairs, hook, line, at, n_args, deps, body) of each hook call of a content, one scan without a shuffle.

    ``files(path)`` are those that have the content, as ``read_once`` gives them; ``by_file`` turns rows into rows of each file.

    ``body`` are the tokens of the arguments before the dependencies; ``deps`` the root names of the entries of the last
    argument, null unless that is an array behind another argument. ``pairs`` are the file's states and setters.
    """
    before = lambda t, k: text_at("tokens", t["at"] - k)
    own = lambda t: ~before(t, 1).isin(".", "function") | ((before(t, 1) == ".") & (before(t, 2) == "React"))
    heads = F.filter("tokens", lambda t: t["text"].isin(DEP_HOOKS) & (text_at("tokens", t["at"] + 1) == "(") & (F.get("tokens", t["at"] + 1)["mate"] >= 0) & own(t))
    calls = F.transform(heads, lambda t: part("tokens", t["at"], F.get("tokens", t["at"] + 1)["mate"]))
    rows = read_once(files).select("content", "files", _pairs("tokens").alias("pairs"), F.explode(calls).alias("call"))
    token = lambda at: F.get("call", at - F.col("at"))
    rows = rows.select("*", F.col("call")[0]["text"].alias("hook"), F.col("call")[0]["line"].alias("line"), F.col("call")[0]["at"].alias("at"), F.element_at("call", -1)["at"].alias("close"))
    cuts = F.transform(F.filter("call", lambda t: (t["text"] == ",") & (t["region"] == F.col("at") + 1) & (t["at"] + 1 != F.col("close"))), lambda t: t["at"])
    rows = rows.select("*", cuts.alias("cuts"))
    rows = rows.select("*", F.when(F.col("close") == F.col("at") + 2, 0).otherwise(F.size("cuts") + 1).alias("n_args"), F.coalesce(F.try_element_at("cuts", F.lit(-1)) + 1, F.col("at") + 2).alias("last"))
    end = F.col("close") - F.when(token(F.col("close") - 1)["text"] == ",", 2).otherwise(1)
    listed = (F.col("n_args") > 1) & (token(F.col("last"))["text"] == "[") & (token(F.col("last"))["mate"] == end)
    entries = F.transform(F.filter("call", lambda t: (t["at"] == F.col("last")) | ((t["text"] == ",") & (t["region"] == F.col("last")))), lambda t: token(t["at"] + 1)["text"])
    deps = F.when(listed, F.filter(entries, lambda x: x.rlike("^[A-Za-z_$]")))
    body = part("call", F.lit(2), F.when(F.col("n_args") > 1, F.col("last") - 2 - F.col("at")).otherwise(F.col("close") - 1 - F.col("at")))
    return rows.select("content", "files", "pairs", "hook", "line", "at", "n_args", deps.alias("deps"), body.alias("body"))


def hooks(files: DataFrame) -> DataFrame:
    """(path, line, hook, body, deps): deps is null without an array, and holds the root names of its entries; the body's
    tokens are parted by blanks."""
    return by_file(hook_calls(files).select("files", "line", "hook", F.array_join(F.transform("body", lambda t: t["text"]), " ").alias("body"), "deps"))


def silent_lines(content: Column, marker: str) -> Column:
    """The lines of a text that a comment ``marker`` on them, or ``marker``-next-line on the one before, silences."""
    lines = F.split(content, "\n")
    hits = F.transform(lines, lambda x, k: F.when(x.rlike(rf"(//|/\*)\s*{marker}(?![\w-])"), k + 1).when(x.rlike(rf"(//|/\*)\s*{marker}-next-line\b"), k + 2))
    return F.when(F.contains(content, F.lit(marker)), F.filter(hits, lambda k: k.isNotNull())).otherwise(F.array().cast("array<int>"))


def ignored_lines(files: DataFrame, marker: str = "loop-ignore") -> DataFrame:
    """(path, line) that a comment ``marker`` on the line, or ``marker``-next-line on the one before, silences."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    same = lines.where(F.col("text").rlike(rf"(//|/\*)\s*{marker}(?![\w-])")).select("path", (F.col("at") + 1).alias("line"))
    after = lines.where(F.col("text").rlike(rf"(//|/\*)\s*{marker}-next-line\b")).select("path", (F.col("at") + 2).alias("line"))
    return same.union(after).distinct()


def module_edges(found: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, names, line): imports resolved to files of the scan, the first suffix that exists."""
    return _resolved(found, files, _target(F.col("path"), F.col("source")))


def aliased_edges(found: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """(src, dst, names, line): imports whose source stands under an alias or package name, resolved to files of the scan.

    ``aliases`` are (alias, target, ord) with absolute targets; the longest alias counts, its targets are tried in order.
    """
    tried = expand_aliases(found.where("source not like '.%'").select("path", "source", "names", "line"), "source", aliases)
    return _resolved(tried, files, F.col("candidate"))


def expanded(files: DataFrame, start: DataFrame) -> DataFrame:
    """(path): the files of ``start(path)`` and all that they import, directly or not."""
    edges = module_edges(imports(files), files).select("src", "dst")
    return start.select("path").union(closure(edges, start=start.select(F.col("path").alias("src"))).select("dst")).distinct()


def _target(path: Column, source: Column) -> Column:
    base = F.regexp_replace(path, r"/[^/]*$", "")
    joined = F.when(F.startswith(source, F.lit("/")), source).otherwise(F.concat_ws("/", base, source))
    # each segment either drops its predecessor or stays
    step = lambda acc, x: F.when(x.isin(".", ""), acc).when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), step), "/"))


def _resolved(found: DataFrame, files: DataFrame, target: Column) -> DataFrame:
    first = F.col("prio") * len(SUFFIXES) if "prio" in found.columns else F.lit(0)
    tries = found.select(F.col("path").alias("src"), "source", "names", "line", first.alias("first"), F.posexplode(F.transform(F.array(*map(F.lit, SUFFIXES)), lambda s: F.concat(target, s))).alias("suffix", "dst"))
    known = files.select(F.col("path").alias("dst")).distinct()
    hit = tries.join(known, "dst").groupBy("src", "source", "line").agg(F.min_by("dst", F.col("first") + F.col("suffix")).alias("dst"), F.first("names").alias("names"))
    return hit.select("src", "dst", "names", "line")

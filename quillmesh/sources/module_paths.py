"""Imports resolved to files: workspace packages, relative paths, aliases of the governing project, and package entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.relational import first_of
from quillmesh.operators.resolution import ancestors
from quillmesh.sources import config_documents as config

#: Suffixes that an import may leave out, in the order they are tried.
EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]


def package_entries(files: DataFrame) -> DataFrame:
    """(dir, ord, entry): where manifests say that a package begins: its exports' main one, then its main file."""
    docs = config.documents(files, ["package.json"]).where("doc is not null")
    get = lambda p: F.nullif(F.try_variant_get("doc", p, "string"), F.lit(""))
    text = F.when(F.schema_of_variant("doc").contains("exports: STRING"), get("$.exports"))
    main = F.coalesce(text, get("$.exports['.'].default"), get("$.exports['.'].import"), F.when(~F.coalesce(get("$.exports['.']"), F.lit("{")).startswith("{"), get("$.exports['.']")))
    rows = docs.select("dir", F.posexplode(F.array(main, get("$.main"))).alias("ord", "to")).where("to is not null")
    return rows.select("dir", "ord", config.resolved(F.concat("dir", F.lit("/"), "to")).alias("entry"))


def _first_file(tried: DataFrame, key: list[str], files: DataFrame) -> DataFrame:
    """(key, dst): of each key's paths ``base`` by ``prio`` the first that is a file, with an extension, by its package's entry
    or as an index, in this order for each."""
    known = files.select(F.col("path").alias("dst")).distinct()
    n = len(EXTENSIONS)
    ends = lambda base, first, within: [F.struct(F.lit(first + k).alias("step"), F.concat(base, F.lit(within + e)).alias("dst")) for k, e in enumerate(EXTENSIONS)]
    base = F.col("base")
    steps = F.array(F.struct(F.lit(0).alias("step"), base.alias("dst")), *ends(base, 1, ""), *ends(base, n + 3, "/index"))
    plain = tried.select(*key, "prio", F.explode(steps).alias("s")).select(*key, "prio", "s.step", "s.dst")
    entries = package_entries(files).select(F.col("dir").alias("base"), (F.col("ord") + n + 1).alias("step"), F.col("entry").alias("dst"))
    hits = plain.unionByName(tried.join(entries, "base").select(*key, "prio", "step", "dst")).join(known, "dst", "left_semi")
    return first_of(hits, key, ["prio", "step"]).select(*key, "dst")


def aliases(files: DataFrame, name: str = "tsconfig.json") -> DataFrame:
    """(document, alias, wild, ord, target): path aliases of project documents with absolute targets; ``wild`` ones had a star
    at their end, which stands for the rest of a source."""
    docs = config.documents(files, [name])
    base = F.concat("dir", F.lit("/"), F.coalesce(F.try_variant_get("doc", "$.compilerOptions.baseUrl", "string"), F.lit(".")))
    rows = docs.select(F.col("path").alias("document"), base.alias("base"), F.explode(F.try_variant_get("doc", "$.compilerOptions.paths", "map<string,array<string>>")).alias("pattern", "targets"))
    rows = rows.select("document", "base", "pattern", F.posexplode("targets").alias("ord", "to"))
    bare = lambda c: F.regexp_replace(c, r"/?\*$", "")
    return rows.select("document", bare(F.col("pattern")).alias("alias"), F.endswith(F.col("pattern"), F.lit("*")).alias("wild"), "ord", config.resolved(F.concat("base", F.lit("/"), bare(F.col("to")))).alias("target"))


def _heads(source: Column) -> Column:
    """The source and the folders above it, the longest first."""
    return F.array_prepend(ancestors(source), source)


def resolved_imports(found: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """(path, source, how, dst) of distinct imports ``found(path, source)``; dst is null where nothing is found.

    A source that is a workspace package or lies in one goes there and nowhere else, else a relative one goes by its file's
    folder, else the longest alias of the document that governs its file gives targets, tried in order. ``files`` are all
    files with their content, manifests and project documents among them.
    """
    key = ["path", "source"]
    wanted = found.select(*key).where("path is not null and source is not null").distinct()
    packages = config.workspace_packages(files).where(F.col("root") == root).select("name", F.col("dir").alias("package_dir"))
    listed = wanted.select(*key, F.posexplode(_heads(F.col("source"))).alias("far", "name")).join(packages, "name")
    inside = first_of(listed, key, ["far"]).select(*key, F.lit("package").alias("how"), F.lit(0).alias("prio"), config.resolved(F.concat("package_dir", F.lit("/"), F.expr("substring(source, length(name) + 2)"))).alias("base"))
    rest = wanted.join(inside.select(*key), key, "left_anti")
    near = F.col("source").startswith("./") | F.col("source").startswith("../")
    relative = rest.where(near).select(*key, F.lit("relative").alias("how"), F.lit(0).alias("prio"), config.resolved(F.concat(config.folder(F.col("path")), F.lit("/"), "source")).alias("base"))
    governed = config.governing_document(found.select("path"), files, root)
    tried = rest.where(~near).join(governed, "path").select(*key, "document", F.posexplode(_heads(F.col("source"))).alias("far", "alias"))
    hit = tried.join(aliases(files), ["document", "alias"]).where("wild or far = 0")
    longest = hit.groupBy(*key).agg(F.min("far").alias("far"))
    by_alias = hit.join(longest, [*key, "far"]).select(*key, F.lit("alias").alias("how"), F.col("ord").alias("prio"), config.resolved(F.concat("target", F.expr("substring(source, length(alias) + 1)"))).alias("base"))
    everything = inside.unionByName(relative).unionByName(by_alias)
    to = _first_file(everything, [*key, "how"], files)
    return wanted.join(everything.select(*key, "how").distinct(), key, "left").join(to, [*key, "how"], "left").select(*key, "how", "dst")

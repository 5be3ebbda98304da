"""Configuration documents of source trees: schema-free JSON as variants, found and layered by folder.

``files`` are rows (path, content). Folders meet by equality on their ancestors, never by comparing all pairs of paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.graph import closure
from quillmesh.operators.relational import first_of
from quillmesh.operators.resolution import ancestors

#: Settings that layers add to, and those that a later layer overrides.
LISTS = ["stableHooks", "unstableHooks", "stableHookPatterns", "unstableHookPatterns", "ignore"]
SCALARS = {"minSeverity": "string", "minConfidence": "string", "includePotentialIssues": "boolean", "strictMode": "boolean", "tsconfigPath": "string", "noPresets": "boolean"}
#: Files that mark a workspace's root, in the order that decides, and where its packages are without other word.
MARKS = {"nx.json": "nx", "turbo.json": "turborepo", "lerna.json": "lerna", "pnpm-workspace.yaml": "pnpm", "package.json": "yarn"}
PACKAGES = ["packages/*", "apps/*", "libs/*"]
_TEXT = r'("(?:\\.|[^"\\])*")'
#: What a project leaves out unless it says otherwise.
EXCLUDED = ["node_modules", "bower_components", "jspm_packages"]
_SOURCE = r"\.(ts|tsx|d\.ts|js|jsx)$"


def plain_json(content: Column) -> Column:
    """JSON without comments and without commas before a closing bracket; texts stay as they are."""
    bare = F.regexp_replace(content, rf"(?s){_TEXT}|//[^\n]*|/\*.*?\*/", "$1")
    return F.regexp_replace(bare, rf"(?s){_TEXT}|,(?=\s*[\]}}])", "$1")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def resolved(path: Column) -> Column:
    """An absolute path without ``.`` and ``..`` segments."""
    step = lambda acc, x: F.when(x.isin(".", ""), acc).when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == "..", acc).otherwise(F.concat(acc, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def documents(files: DataFrame, names: list[str]) -> DataFrame:
    """(path, dir, name, rank, doc) of the files with these base names; ``rank`` is the name's place, ``doc`` null for what
    is no JSON, such as modules, which are not run here."""
    rank = F.coalesce(*(F.when(F.col("name") == n, F.lit(k)) for k, n in enumerate(names)))
    rows = files.select("path", "content", folder(F.col("path")).alias("dir"), base_name(F.col("path")).alias("name")).where(F.col("name").isin(names))
    return rows.select("path", "dir", "name", rank.alias("rank"), F.try_parse_json(plain_json(F.col("content"))).alias("doc"))


def nearest_document(starts: DataFrame, start: str, docs: DataFrame) -> DataFrame:
    """(start, path): the document of the nearest folder at or above each start folder, of several there the one named first."""
    tried = starts.select(start).distinct().select(start, F.posexplode(F.array_prepend(ancestors(F.col(start)), F.col(start))).alias("_far", "dir"))
    return first_of(tried.join(docs.select("dir", "path", "rank"), "dir"), [start], ["_far", "rank"]).select(start, "path")


def layered_settings(starts: DataFrame, start: str, docs: DataFrame, defaults: dict[str, object] | None = None) -> DataFrame:
    """(start, lists..., scalars..., customFunctions): the defaults with the nearest readable document of each start laid over them.

    Lists are the defaults' and then the document's, scalars the document's where it has one, functions the document's and
    those of the defaults that it does not name. Values of another type count as absent.
    """
    given = defaults or {}
    near = starts.select(start).distinct().join(nearest_document(starts, start, docs.where("doc is not null")), start, "left").join(docs.select("path", "doc"), "path", "left")
    get = lambda k, t: F.try_variant_get("doc", f"$.{k}", t)
    plain = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    lists = [F.concat(plain(given.get(k, [])), F.coalesce(get(k, "array<string>"), plain([]))).alias(k) for k in LISTS]
    scalars = [F.coalesce(get(k, t), F.lit(given.get(k)).cast(t)).alias(k) for k, t in SCALARS.items()]
    named = F.coalesce(get("customFunctions", "map<string,struct<stable:boolean,deferred:boolean>>"), F.create_map().cast("map<string,struct<stable:boolean,deferred:boolean>>"))
    base = [F.struct(F.lit(n).alias("key"), F.struct(F.lit(v.get("stable")).cast("boolean").alias("stable"), F.lit(v.get("deferred")).cast("boolean").alias("deferred")).alias("value")) for n, v in (given.get("customFunctions") or {}).items()]
    own = F.array(*base) if base else F.array().cast("array<struct<key:string,value:struct<stable:boolean,deferred:boolean>>>")
    functions = F.map_from_entries(F.concat(F.map_entries(named), F.filter(own, lambda e: ~F.map_contains_key(named, e["key"])))).alias("customFunctions")
    return near.select(start, *lists, *scalars, functions)


def dependencies(docs: DataFrame) -> DataFrame:
    """(path, package, version) of manifests: dependencies, and those for development, which win where both name a package."""
    held = lambda k: F.coalesce(F.try_variant_get("doc", f"$.{k}", "map<string,string>"), F.create_map().cast("map<string,string>"))
    rows = docs.select("path", held("dependencies").alias("own"), held("devDependencies").alias("dev"))
    rows = rows.select("path", F.concat(F.map_entries("dev"), F.filter(F.map_entries("own"), lambda e: ~F.map_contains_key("dev", e["key"]))).alias("all"))
    return rows.select("path", F.explode("all").alias("e")).select("path", F.col("e.key").alias("package"), F.col("e.value").alias("version"))


def _glob(pattern: Column) -> Column:
    """A regular expression for a glob over a path: ``**`` any folders, ``*`` and ``?`` within one name."""
    quoted = F.regexp_replace(F.regexp_replace(pattern, r"^\./|/+$", ""), r"[.+^$(){}|\[\]\\]", r"\\$0")
    stars = F.regexp_replace(F.regexp_replace(quoted, r"\*\*/", "\u0001"), r"\*\*", "\u0002")
    return F.concat(F.lit("^"), F.replace(F.replace(F.regexp_replace(F.regexp_replace(stars, r"\*", "[^/]*"), r"\?", "[^/]"), F.lit("\u0001"), F.lit("(?:.*/)?")), F.lit("\u0002"), F.lit(".*")), F.lit("$"))


def workspaces(files: DataFrame) -> DataFrame:
    """(root, kind, patterns): folders that a mark makes a workspace's root; of several marks the first in MARKS decides.

    Patterns come from the manifest's workspaces, an array or an object with packages, else from the list of the kind's own
    file, else from PACKAGES. A manifest without workspaces is no mark.
    """
    docs = documents(files, list(MARKS))
    spaces = lambda: F.coalesce(F.try_variant_get("doc", "$.workspaces", "array<string>"), F.try_variant_get("doc", "$.workspaces.packages", "array<string>"))
    manifest = F.col("name") == "package.json"
    lines = F.regexp_extract_all(F.regexp_extract(F.col("content"), r"(?ms)^packages:[ \t]*\r?\n((?:[ \t]*(?:-[^\n]*|#[^\n]*)?(?:\n|\z))+)", 1), F.lit(r"(?m)^[ \t]*-[ \t]*['\"]?([^'\"\n#]+?)['\"]?[ \t\r]*(?:#[^\n]*)?$"), F.lit(1))
    yaml = files.where(base_name(F.col("path")) == "pnpm-workspace.yaml").select(folder(F.col("path")).alias("root"), lines.alias("yaml"))
    some = lambda x: F.when(F.size(x) > 0, x)
    rows = docs.select(F.col("dir").alias("root"), "rank", "name", F.when(manifest, spaces()).alias("spaces"), F.when(F.col("name") == "lerna.json", F.try_variant_get("doc", "$.packages", "array<string>")).alias("lerna"), F.when(manifest, F.try_variant_get("doc", "$.workspaces", "variant").isNotNull()).otherwise(True).alias("marks"))
    found = rows.groupBy("root").agg(F.min(F.when(F.col("marks"), F.struct("rank", "name"))).alias("mark"), F.max("spaces").alias("spaces"), F.max("lerna").alias("lerna")).where("mark is not null")
    kind = F.coalesce(*(F.when(F.col("mark.name") == n, F.lit(k)) for n, k in MARKS.items()))
    found = found.select("root", kind.alias("kind"), "spaces", "lerna").join(yaml, "root", "left")
    patterns = F.coalesce(some(F.col("spaces")), F.when(F.col("kind") == "pnpm", some(F.col("yaml"))), F.when(F.col("kind") == "lerna", some(F.col("lerna"))), F.array(*map(F.lit, PACKAGES)))
    return found.select("root", "kind", patterns.alias("patterns"))


def workspace_packages(files: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(root, name, dir): packages of workspaces, folders with a named manifest that a pattern of a root above them fits.

    Of packages of one name in a workspace the last by pattern, then folder, counts. A pattern with ``!`` in front takes
    folders out.
    """
    roots = workspaces(files) if roots is None else roots
    packages = documents(files, ["package.json"]).select("dir", F.try_variant_get("doc", "$.name", "string").alias("name")).where("name != ''")
    tried = packages.select("dir", "name", F.explode(ancestors(F.col("dir"))).alias("root")).join(roots, "root").withColumn("rest", F.expr("substring(dir, length(root) + 2)"))
    hits = F.filter(F.transform("patterns", lambda p, k: F.when(~F.startswith(p, F.lit("!")) & F.regexp_like(F.col("rest"), _glob(p)), k)), lambda k: k.isNotNull())
    barred = F.exists("patterns", lambda p: F.startswith(p, F.lit("!")) & F.regexp_like(F.col("rest"), _glob(F.regexp_replace(p, "^!", ""))))
    fit = tried.select("root", "name", "dir", F.array_max(hits).alias("k"), barred.alias("barred")).where("k is not null and not barred")
    return fit.groupBy("root", "name").agg(F.max(F.struct("k", "dir")).alias("last")).select("root", "name", F.col("last.dir").alias("dir"))


def project_references(files: DataFrame, name: str = "tsconfig.json") -> DataFrame:
    """(src, dst, ord): references of project documents, to the document of a folder if that has one, else to the path itself."""
    docs = documents(files, [name])
    refs = docs.select("path", "dir", F.posexplode(F.try_variant_get("doc", "$.references", "array<struct<path:string>>")).alias("ord", "r")).where("r.path is not null")
    at = F.when(F.startswith(F.col("r.path"), F.lit("/")), F.col("r.path")).otherwise(F.concat("dir", F.lit("/"), "r.path"))
    refs = refs.select(F.col("path").alias("src"), "ord", resolved(at).alias("to"))
    inside = docs.select(F.col("dir").alias("to"), F.col("path").alias("inner"))
    return refs.join(inside, "to", "left").select("src", F.coalesce("inner", "to").alias("dst"), "ord")


def all_references(references: DataFrame, start: DataFrame) -> DataFrame:
    """(src, dst): every document that those of ``start(src)`` refer to, directly or not."""
    return closure(references, start=start).select("src", "dst").where("src != dst").distinct()


def governing_document(sources: DataFrame, files: DataFrame, root: str, name: str = "tsconfig.json") -> DataFrame:
    """(path, document): for each source below ``root`` the nearest project document above it that includes it, else the root's,
    null if there is neither.

    A document includes the sources it lists under ``files`` and those that a pattern of ``include`` fits, by default all if it
    lists none, but for those under a pattern of ``exclude``. A pattern that names a folder fits what lies in it.
    """
    get = lambda k: F.try_variant_get("doc", f"$.{k}", "array<string>")
    docs = documents(files, [name]).where("doc is not null").where((F.col("dir") == root) | F.startswith(F.col("dir"), F.lit(f"{root}/")))
    include = F.coalesce(get("include"), F.when(get("files").isNull(), F.array(F.lit("**/*"))), F.array().cast("array<string>"))
    docs = docs.select("dir", F.col("path").alias("document"), include.alias("include"), F.coalesce(get("files"), F.array().cast("array<string>")).alias("listed"), F.coalesce(get("exclude"), F.array(*map(F.lit, EXCLUDED))).alias("exclude"))
    tried = sources.select("path").distinct().select("path", F.posexplode(ancestors(F.col("path"))).alias("far", "dir")).join(docs, "dir").withColumn("rest", F.expr("substring(path, length(dir) + 2)"))
    inside = lambda p: F.regexp_like(F.col("rest"), _glob(p)) | F.regexp_like(F.col("rest"), _glob(F.concat(p, F.lit("/**"))))
    fits = (F.exists("include", inside) & F.col("rest").rlike(_SOURCE) & ~F.exists("exclude", inside)) | F.exists("listed", lambda p: F.regexp_replace(p, r"^\./", "") == F.col("rest"))
    near = first_of(tried.where(fits).select("path", "far", "document"), ["path"], ["far"])
    above = docs.where(F.col("dir") == root).select(F.col("document").alias("_root"))  # one row at most
    return sources.select("path").distinct().join(near.select("path", "document"), "path", "left").join(F.broadcast(above), F.lit(True), "left").select("path", F.coalesce("document", "_root").alias("document"))

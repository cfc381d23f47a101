"""Scalar functions on names, routes, types and paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make_id(repo: Column, kind: Column, fqn: Column) -> Column:
    """Identity of a node: first 16 hex digits of SHA-1 over repo, kind and fqn, NUL between them."""
    return F.substring(F.sha1(F.concat_ws("\0", repo, kind, fqn)), 1, 16)


def body_hash(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 16)


def finding_id(kind: Column, place: Column, sink_hash: Column) -> Column:
    """Stable id of a finding; missing parts count as empty."""
    e = F.lit("")
    return F.substring(F.sha1(F.concat_ws("\0", F.coalesce(kind, e), F.coalesce(place, e), F.coalesce(sink_hash, e))), 1, 16)


def _unquoted(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "^['\"]+|['\"]+$", "")


def route(c: Column) -> Column:
    """Path parameters as ``*``, one leading slash, none at the end; empty stays empty."""
    r = _unquoted(c)
    for param in (r"\{[^/}]*\}", "<[^/>]*>", ":[^/]+"):
        r = F.regexp_replace(r, param, "*")
    r = F.when(F.startswith(r, F.lit("/")), r).otherwise(F.concat(F.lit("/"), r))
    r = F.when(F.length(r) > 1, F.regexp_replace(r, "/+$", "")).otherwise(r)
    return F.when(_unquoted(c) == "", F.lit("")).otherwise(r)


def segments(c: Column) -> Column:
    return F.filter(F.split(c, "/"), lambda x: x != "")


def tail(c: Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(c, ".", -1)


def dotted(c: Column) -> Column:
    """Event and policy names: camel case, separators and blanks to single dots, lower case."""
    n = F.regexp_replace(_unquoted(c), "(?<=[a-z0-9])(?=[A-Z])", ".")
    n = F.regexp_replace(F.lower(n), r"[_\-/:]+|\s+", ".")
    return F.regexp_replace(F.regexp_replace(n, r"\.{2,}", "."), r"^\.+|\.+$", "")


def simple_type(c: Column) -> Column:
    """A type's simple name, without generics, brackets and qualifier."""
    return tail(F.trim(F.replace(F.substring_index(c, "<", 1), F.lit("[]"), F.lit(""))))


def source_name(c: Column) -> Column:
    """Source name of a binary class name; empty for anonymous classes."""
    return F.when(F.regexp_like(c, F.lit(r"\$\d+$")), F.lit("")).otherwise(F.replace(c, F.lit("$"), F.lit(".")))


def descriptor_types(c: Column) -> Column:
    """Parameter descriptors of a JVM method descriptor."""
    return F.regexp_extract_all(F.regexp_extract(c, r"^\(([^)]*)\)", 1), F.lit(r"(\[*(?:[BCDFIJSZ]|L[^;]+;))"), 1)


def slug(c: Column, default: str = "project") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9_-]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(default)).otherwise(s)


#: Artifact kinds by file name and by extension, languages by extension.
ARTIFACT_NAMES = {
    "buildconfig": ["pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "ivy.xml", ".classpath", "manifest.mf"],
    "webdeploy": ["web.xml"],
    "jsconfig": ["tsconfig.json", "jsconfig.json", "package.json"],
    "pyconfig": ["pyproject.toml", "pyrightconfig.json", "setup.cfg"],
}
ARTIFACT_EXTENSIONS = {"bytecode": ["class"], "archive": ["jar", "war", "ear"], "taglib": ["tld"], "stub": ["pyi"]}
LANGUAGES = {"java": ["java"], "python": ["py"], "sql": ["sql"], "jsp": ["jsp", "jspf", "tag"], "javascript": ["js", "jsx", "mjs", "cjs"], "typescript": ["ts", "mts", "cts"], "tsx": ["tsx"]}


def _case(c: Column, table: dict[str, list[str]]) -> Column:
    out = F.lit(None).cast("string")
    for value, keys in reversed(table.items()):
        out = F.when(c.isin(keys), F.lit(value)).otherwise(out)
    return out


def _extension(name: Column) -> Column:
    return F.regexp_extract(name, r"^.+\.([^.]*)$", 1)


def artifact_kind(relpath: Column) -> Column:
    """Kind of build or deployment artifact, or null. File names go before extensions, and
    declaration files before the extension they share with sources."""
    name = F.lower(F.substring_index(F.replace(relpath, F.lit("\\"), F.lit("/")), "/", -1))
    stub = F.when(F.endswith(name, F.lit(".d.ts")), F.lit("stub"))
    return F.coalesce(_case(name, ARTIFACT_NAMES), stub, _case(_extension(name), ARTIFACT_EXTENSIONS))


def source_lang(relpath: Column) -> Column:
    """Language to parse a path as; null for artifacts and unknown extensions."""
    name = F.substring_index(relpath, "/", -1)
    return F.when(artifact_kind(relpath).isNull(), _case(_extension(name), LANGUAGES))


_PRIMITIVES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}


def type_name(descriptor: Column) -> Column:
    """A single type descriptor as a Java type."""
    dims = F.length(F.regexp_extract(descriptor, r"^(\[*)", 1))
    base = F.regexp_replace(descriptor, r"^\[*", "")
    named = F.regexp_replace(F.regexp_extract(base, r"^L([^;]+);$", 1), "/", ".")
    out = named
    for k, v in _PRIMITIVES.items():
        out = F.when(base == k, v).otherwise(out)
    return F.concat(out, F.repeat(F.lit("[]"), dims))


def descriptor_params(descriptor: Column) -> Column:
    """Java types of a method descriptor's parameters; null for what is no method descriptor."""
    ok = F.rlike(descriptor, F.lit(r"^\((?:\[*(?:[BCDFIJSZ]|L[^;]+;))*\)(?:V|\[*(?:[BCDFIJSZ]|L[^;]+;))$"))
    inside = F.regexp_extract(descriptor, r"^\(([^)]*)\)", 1)
    parts = F.regexp_extract_all(inside, F.lit(r"(\[*(?:[BCDFIJSZ]|L[^;]+;))"), 1)
    return F.when(ok, F.transform(parts, type_name))


def erased(type_: Column) -> Column:
    """A type for comparison: without generics, package and outer class; varargs are an array."""
    t = F.regexp_replace(F.regexp_replace(F.trim(type_), r"<.*>", ""), r"\.\.\.$", "[]")
    return F.regexp_replace(t, r"^.*[.$]", "")


def lookup_name(method: Column, owner: Column) -> Column:
    """A constructor is looked up by its class's simple name."""
    return F.when(method == "<init>", F.regexp_replace(owner, r"^.*[.$]", "")).otherwise(method)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host in lower case, path); a relative address has no host, and its path no query."""
    absolute = F.rlike(url, F.lit(r"^(?:[A-Za-z][\w+.-]*:)?//"))
    host = F.when(absolute, F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1))).otherwise(F.lit(""))
    path = F.when(absolute, F.regexp_extract(url, r"^(?:[A-Za-z][\w+.-]*:)?//[^/?#]*([^?#]*)", 1)).otherwise(F.regexp_extract(url, r"^([^?#]*)", 1))
    return host, F.when(absolute & (path == ""), "/").otherwise(path)


def match_key(method: Column, path: Column) -> tuple[Column, Column]:
    """Verb (GET by default) and normal route of an endpoint."""
    return F.when(F.coalesce(F.trim(method), F.lit("")) == "", "GET").otherwise(F.upper(F.trim(method))), route(path)

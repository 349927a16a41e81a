"""Files as rows: scanning, ignore rules, content checks, language and parser choice."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrion import config

# Never indexed, known generated files, languages by suffix.
SAFETY = ("**/.git/**", "**/node_modules/**", "**/.env", "**/.env.*", "**/*.pem", "**/*.key")
LOCKS = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "cargo.lock", "go.sum", "composer.lock", "gemfile.lock")
GENERATED = r"(?i)@generated|auto-?generated|do not edit|code generated by"
LANGUAGES = {
    "ts": "typescript", "tsx": "tsx", "js": "tsx", "jsx": "tsx", "py": "python", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cs": "c_sharp", "php": "php", "rb": "ruby", "swift": "swift", "kt": "kotlin",
}


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob of *, **, ? and {a,b} on a relative path."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out, i = out + "(?:" + "|".join(re.escape(x) for x in pattern[i + 1 : end].split(",")) + ")", end + 1
            continue
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
        i += 1
    return f"^{out}$"


def ignored(path: Column, patterns: list[str], ignore_file: list[str] | None = None) -> Column:
    """Whether a path relative to the root is ignored: by the safety rules, whatever else says; else by the last pattern
    that matches, where one with ! takes back. Lines of an ignore file match names at any depth, and folders with all below."""
    result = F.lit(False)
    for p in patterns:
        keep = p.startswith("!")
        result = F.when(path.rlike(glob_regex(p.removeprefix("!"))), F.lit(not keep)).otherwise(result)
    for line in ignore_file or []:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        keep, body = line.startswith("!"), line.removeprefix("!").rstrip("/")
        base = body.lstrip("/") if "/" in body else f"**/{body}"
        hit = path.rlike(glob_regex(base)) | path.rlike(glob_regex(f"{base}/**"))
        result = F.when(hit, F.lit(not keep)).otherwise(result)
    for p in SAFETY:
        result = path.rlike(glob_regex(p)) | result
    return result | path.startswith("../") | path.startswith("/")


def is_binary(content: Column) -> Column:
    """A zero byte among the first 8000."""
    return F.contains(F.substring(content, 1, 8000), F.lit(b"\0"))


def is_generated(path: Column, text: Column) -> Column:
    """By name, by a marker at the top, or by lines far longer than people write."""
    base = F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))
    lines = F.transform(F.slice(F.split(F.substring(text, 1, 50_000), "\n"), 1, 200), lambda x: F.length(x))
    mean = F.aggregate(lines, F.lit(0), lambda a, x: a + x) / F.greatest(F.size(lines), F.lit(1))
    return base.isin(*LOCKS) | base.rlike(r"\.min\.") | F.substring(text, 1, 500).rlike(GENERATED) | (mean > 500) | (F.array_max(lines) > 5000)


def language(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.element_at(known, F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)))


def parser(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.endswith(".proto"), "protobuf").when(language(path).isNotNull(), "code").when(low.rlike(r"\.(json|ya?ml|toml|ini)$"), "config").when(low.rlike(r"\.mdx?$"), "markdown").otherwise("text")


def scanned(spark: SparkSession, root: str, cfg: config.Config | None = None, ignore_file: list[str] | None = None) -> DataFrame:
    """(path, hash, length, text, language, parser, modified_ms) of the files under root that are indexed.

    Size and name decide before content is decoded; a file that several patterns match is one row.
    """
    cfg = cfg or config.Config()
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub("^file:/*", "/", root.rstrip("/"))
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), f"^{re.escape(base)}/", "")
    f = f.where(F.col("length") <= config.MAX_FILE_BYTES).withColumn("path", rel)
    f = f.where(F.col("path").rlike("|".join(map(glob_regex, cfg.patterns))) & ~ignored(F.col("path"), list(cfg.ignore), ignore_file))
    f = f.where(~is_binary(F.col("content"))).withColumn("text", F.decode("content", "UTF-8")).where(~is_generated(F.col("path"), F.col("text")))
    return f.select("path", F.sha2("content", 256).alias("hash"), "length", "text", language(F.col("path")).alias("language"), parser(F.col("path")).alias("parser"), F.unix_millis("modificationTime").alias("modified_ms")).dropDuplicates(["path"])

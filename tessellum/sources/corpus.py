"""Corpus sources: directories of text files and tables of texts, as one ``files`` frame (rel_path, kb, text)."""

from __future__ import annotations

import configparser
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_regex, kb_of, normalized

# Kinds of files that are read as text, converted or passed over.
SUFFIXES = ("md", "markdown", "mdx", "txt", "rst", "log", "csv", "json", "yaml", "yml", "py", "js", "ts", "tsx", "jsx", "java", "go", "rs", "toml", "ini", "sh")
MARKDOWN, STRUCTURED, BINARY = ("md", "markdown", "mdx"), ("json", "yaml", "yml", "toml", "ini"), ("docx", "xlsx", "xls", "pdf")
IGNORED = (".git", "node_modules", "dist", "build", ".venv", "venv", "__pycache__", ".next", "target")


def from_table(docs: DataFrame) -> DataFrame:
    """``documents`` as files: rel_path, kb, text, doc_id."""
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(path.alias("rel_path"), F.coalesce("source", F.lit("")).alias("kb"), F.col("text"), "doc_id")


def flatten(value, prefix: str = "") -> list[str]:
    """Nested data as lines ``a.b[0] = scalar``; empty containers give none."""
    if isinstance(value, dict):
        return [line for k, v in value.items() for line in flatten(v, f"{prefix}.{k}" if prefix else str(k))]
    if isinstance(value, list):
        return [line for i, v in enumerate(value) for line in flatten(v, f"{prefix}[{i}]")]
    shown = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str)
    return [f"{prefix} = {shown}" if prefix else str(shown)]


def structured_text(text: str, suffix: str) -> str | None:
    """The flattened form of JSON, TOML, INI or YAML; None if it can't be parsed, or for YAML without a parser installed."""
    yaml = None
    if suffix in ("yaml", "yml"):
        try:
            import yaml
        except ImportError:
            return plain_yaml(text)
    try:
        if suffix == "json":
            data = json.loads(text)
        elif suffix == "toml":
            import tomllib

            data = tomllib.loads(text)
        elif suffix == "ini":
            parser = configparser.ConfigParser()
            parser.read_string(text)
            data = {s: dict(parser.items(s)) for s in parser.sections()}
        elif suffix in ("yaml", "yml"):
            data = yaml.safe_load(text)
        else:
            return None
    except (ValueError, configparser.Error, *([yaml.YAMLError] if yaml else [])):  # the text stays as it is
        return None
    return "\n".join(flatten(data))


def plain_yaml(text: str) -> str | None:
    """Nested mappings and lists of plain scalars, flattened without a YAML parser; None for anything else."""
    out: list[str] = []
    path: list[tuple[int, str, int]] = []  # indent, name, next place of a list
    for raw in text.split("\n"):
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#") or line.strip() == "---":
            continue
        indent, body = len(line) - len(line.lstrip(" ")), line.strip()
        item = body.startswith("- ")
        while path and (path[-1][0] > indent or (path[-1][0] == indent and not item)):
            path.pop()
        if item:
            if not path:
                return None
            at, name, n = path[-1]
            path[-1] = (at, name, n + 1)
            body, own = body[2:].strip(), f"{'.'.join(p[1] for p in path)}[{n}]"
            if ": " in body or body.endswith(":") or body[:1] in "[{|>&*!":
                return None
            out.append(f"{own} = {body.strip(chr(34) + chr(39))}")
            continue
        key, colon, value = body.partition(":")
        if not colon or (value and value[0] != " ") or value.strip()[:1] in ("[", "{", "|", ">", "&", "*", "!"):
            return None
        if value.strip():
            out.append(f"{'.'.join([*(p[1] for p in path), key.strip()])} = {value.strip().strip(chr(34) + chr(39))}")
        else:
            path.append((indent, key.strip(), 0))
    return "\n".join(out)


def from_directory(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), convert=None) -> DataFrame:
    """Text files under a folder of any store: rel_path, suffix, kb, text (decoded, bad bytes dropped; structured ones flattened).

    Ignored folders and excluded patterns are filtered on paths alone, before contents are read. ``convert(bytes, suffix)``
    may turn further formats into text. Files that cannot be read as text are left out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = "/" + root.split(":", 1)[-1].strip("/") if ":" in root.split("/")[0] else root.rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "^" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in plain) + "/", "")
    found = raw.select(rel.alias("rel_path"), "length", "modificationTime", "content").withColumn("suffix", F.lower(F.regexp_extract("rel_path", r"\.([^./]+)$", 1)))
    found = found.where(~F.arrays_overlap(F.split("rel_path", "/"), F.array(*[F.lit(x) for x in IGNORED])))
    for pattern in exclude:
        found = found.where(~(F.col("rel_path").rlike(glob_regex(pattern)) | F.element_at(F.split("rel_path", "/"), -1).rlike(glob_regex(pattern))))
    if convert is None:
        found = found.where(F.col("suffix").isin(*SUFFIXES))

    @F.pandas_udf("string")
    def decoded(contents: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for content, suffix in contents:
            out = []
            for c, s in zip(content, suffix):
                text = bytes(c).decode("utf-8", "ignore") if s in SUFFIXES else convert(bytes(c), s)
                out.append(text if text is None else structured_text(text, s) or text)
            yield pd.Series(out, dtype=object)

    return found.select("rel_path", "suffix", kb_of(F.col("rel_path")).alias("kb"), "length", "modificationTime", normalized(decoded("content", "suffix")).alias("text")).where("text is not null")

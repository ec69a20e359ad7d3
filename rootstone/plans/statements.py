"""Recognises statements that Spark does not run itself, and rewrites what it writes differently."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from rootstone.errors import InvalidError

# Column types, signed and unsigned, and the ranges of integers.
TYPES: dict[str, T.DataType] = {
    "tinyint": T.ByteType(), "boolean": T.ByteType(), "bool": T.ByteType(), "smallint": T.ShortType(), "mediumint": T.IntegerType(), "int": T.IntegerType(),
    "integer": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "real": T.DoubleType(), "char": T.StringType(),
    "varchar": T.StringType(), "text": T.StringType(), "tinytext": T.StringType(), "mediumtext": T.StringType(), "longtext": T.StringType(),
    "binary": T.BinaryType(), "varbinary": T.BinaryType(), "blob": T.BinaryType(), "tinyblob": T.BinaryType(), "mediumblob": T.BinaryType(),
    "longblob": T.BinaryType(), "datetime": T.TimestampNTZType(), "timestamp": T.TimestampNTZType(),
}
UNSIGNED: dict[str, T.DataType] = {
    "tinyint": T.ShortType(), "smallint": T.IntegerType(), "mediumint": T.IntegerType(), "int": T.LongType(), "integer": T.LongType(), "bigint": T.DecimalType(20, 0),
}
BITS = {"tinyint": 8, "boolean": 8, "bool": 8, "smallint": 16, "mediumint": 24, "int": 32, "integer": 32, "bigint": 64}

NAME = r"(?:`[^`]+`|\w+)"


def bare(name: str) -> str:
    return name.strip().strip("`")


def masked(text: str) -> str:
    """The text with the inside of quotes blanked, so that words and brackets can be searched for."""
    return re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"", lambda m: m.group()[0] + " " * (len(m.group()) - 2) + m.group()[0], text)


def split_top(text: str, separator: str = ",") -> list[str]:
    """Parts between separators that stand outside of quotes and brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(masked(text)):
        depth += (c == "(") - (c == ")")
        if c == separator and not depth:
            out.append(text[at:i].strip())
            at = i + 1
    return [*out, text[at:].strip()]


def find_top(text: str, word: str) -> int:
    """Where a word stands outside of quotes and brackets, or -1."""
    plain, depth = masked(text), 0
    levels = []
    for c in plain:
        levels.append(depth)
        depth += (c == "(") - (c == ")")
    return next((m.start() for m in re.finditer(rf"\b{word}\b", plain, re.I) if not levels[m.start()]), -1)


def bracketed(text: str) -> tuple[str, str]:
    """The inside of the first bracket, and what follows it."""
    plain, depth, first = masked(text), 0, text.index("(")
    for i in range(first, len(plain)):
        depth += (plain[i] == "(") - (plain[i] == ")")
        if not depth:
            return text[first + 1 : i], text[i + 1 :]
    raise InvalidError("a bracket is not closed")


@dataclass
class Column:
    name: str
    kind: T.DataType
    declared: str
    nullable: bool = True
    auto: bool = False


@dataclass
class CreateTable:
    name: str
    columns: list[Column]
    primary: list[str]
    indexes: dict[str, dict]
    comment: str = ""
    if_missing: bool = False


@dataclass
class Statement:
    """kind and its parts."""

    kind: str
    parts: dict = field(default_factory=dict)


def column_type(text: str) -> tuple[T.DataType, str]:
    m = re.match(r"(\w+)(\s*\([^)]*\))?(\s+unsigned\b)?", text.strip(), re.I)
    base = m.group(1).lower() if m else ""
    kinds = UNSIGNED if m and m.group(3) else TYPES
    if base == "double" and re.match(r"double\s+precision\b", text, re.I):
        base = "double"
    if base not in kinds:
        raise InvalidError(f"columns cannot have the type {text.split()[0] if text.split() else ''}")
    return kinds[base], (base + (m.group(2) or "").replace(" ", "") + (" unsigned" if m.group(3) else ""))


def columns_of(text: str) -> list[str]:
    found = [x.strip() for x in split_top(text)]
    if any("(" in x for x in found):
        raise InvalidError("indexes on prefixes are not supported")
    return [bare(re.sub(r"\s+(asc|desc)$", "", x, flags=re.I)) for x in found]


def create_table(m: re.Match, text: str) -> CreateTable:
    body, rest = bracketed(text[m.end(2) :])
    columns, primary, indexes = [], [], {}
    for part in split_top(body):
        if k := re.match(r"(?:constraint\s+\w+\s+)?primary\s+key\s*", part, re.I):
            primary = columns_of(bracketed(part[k.end() :])[0])
        elif k := re.match(rf"(unique)?\s*(?:\b(?:key|index)\b)\s*({NAME})?\s*\(|(unique)\s*({NAME})?\s*\(", part, re.I):
            own = columns_of(bracketed(part)[0])
            indexes[bare(k.group(2) or k.group(4) or "_".join(own))] = {"columns": own, "unique": bool(k.group(1) or k.group(3))}
        elif re.match(r"(?:constraint\b.*)?(?:foreign\s+key|check)\b", part, re.I):
            raise InvalidError("foreign keys and checks are not supported")
        else:
            k = re.match(rf"({NAME})\s+(.*)", part, re.S)
            if not k:
                raise InvalidError(f"cannot read the column {part!r}")
            kind, declared = column_type(k.group(2))
            options = masked(k.group(2))
            if re.search(r"\b(default|references|check|generated)\b", options, re.I):
                raise InvalidError("defaults, references, checks and generated columns are not supported")
            name = bare(k.group(1))
            if re.search(r"\bprimary\s+key\b", options, re.I):
                primary = [name]
            elif re.search(r"\bunique\b", options, re.I):
                indexes[name] = {"columns": [name], "unique": True}
            columns.append(Column(name, kind, declared, not re.search(r"\bnot\s+null\b", options, re.I), bool(re.search(r"\bauto_increment\b", options, re.I))))
    if not primary:
        raise InvalidError("a table needs a primary key")
    known = [c.name.lower() for c in columns]
    for name in [*primary, *(c for i in indexes.values() for c in i["columns"])]:
        if name.lower() not in known:
            raise InvalidError(f"there is no column {name}")
    for c in columns:
        c.nullable = c.nullable and c.name.lower() not in [p.lower() for p in primary]
    comment = re.search(r"comment\s*=?\s*'((?:[^']|'')*)'", rest, re.I)
    return CreateTable(bare(m.group(2)), columns, primary, indexes, comment.group(1) if comment else "", bool(m.group(1)))


def parse(text: str) -> Statement:
    """The statement's kind: what is not known here is a query."""
    text = text.strip().rstrip(";").strip()
    one = lambda pattern: re.match(pattern + r"\s*$", text, re.I | re.S)
    head = lambda pattern: re.match(pattern, text, re.I | re.S)
    if m := one(r"(?:begin(?:\s+work)?|start\s+transaction(\s+read\s+only|\s+read\s+write)?)"):
        return Statement("begin", {"read_only": bool(m.group(1) and "only" in m.group(1).lower())})
    if one(r"commit(?:\s+work)?"):
        return Statement("commit")
    if m := one(rf"rollback(?:\s+work)?(?:\s+to\s+(?:savepoint\s+)?({NAME}))?"):
        return Statement("rollback_to", {"name": bare(m.group(1))}) if m.group(1) else Statement("rollback")
    if m := one(rf"savepoint\s+({NAME})"):
        return Statement("savepoint", {"name": bare(m.group(1))})
    if m := one(rf"release\s+savepoint\s+({NAME})"):
        return Statement("release", {"name": bare(m.group(1))})
    if m := one(r"set\s+(?:session\s+|@@(?:session\.)?)?autocommit\s*=\s*(\w+)"):
        return Statement("autocommit", {"on": m.group(1).lower() in ("1", "on", "true")})
    if m := head(rf"create\s+table\s+(if\s+not\s+exists\s+)?({NAME})\s*(?=\()"):
        return Statement("create_table", {"table": create_table(m, text)})
    if m := one(rf"drop\s+table\s+(if\s+exists\s+)?({NAME}(?:\s*,\s*{NAME})*)"):
        return Statement("drop_table", {"names": [bare(n) for n in m.group(2).split(",")], "if_there": bool(m.group(1))})
    if m := one(rf"(?:rename\s+table\s+({NAME})\s+to|alter\s+table\s+({NAME})\s+rename(?:\s+to|\s+as)?)\s+({NAME})"):
        return Statement("rename_table", {"old": bare(m.group(1) or m.group(2)), "new": bare(m.group(3))})
    if m := one(rf"truncate(?:\s+table)?\s+({NAME})"):
        return Statement("truncate", {"name": bare(m.group(1))})
    if m := head(rf"(?:create\s+(unique\s+)?index\s+({NAME})\s+(?:using\s+(\w+)\s+)?on\s+({NAME})|alter\s+table\s+({NAME})\s+add\s+(unique\s+)?(?:index|key)\s*({NAME})?)\s*(?=\()"):
        own = columns_of(bracketed(text[m.end() :])[0])
        if (m.group(3) or "btree").lower() != "btree":
            raise InvalidError("indexes are btree")
        name = bare(m.group(2) or m.group(7) or "_".join(own))
        return Statement("create_index", {"table": bare(m.group(4) or m.group(5)), "name": name, "columns": own, "unique": bool(m.group(1) or m.group(6))})
    if m := one(rf"drop\s+index\s+({NAME})\s+on\s+({NAME})"):
        return Statement("drop_index", {"name": bare(m.group(1)), "table": bare(m.group(2))})
    if m := one(rf"alter\s+table\s+({NAME})\s+rename\s+(?:index|key)\s+({NAME})\s+to\s+({NAME})"):
        return Statement("rename_index", {"table": bare(m.group(1)), "old": bare(m.group(2)), "new": bare(m.group(3))})
    if head(r"alter\s+table\b"):
        raise InvalidError("tables cannot be altered")
    if m := head(rf"insert\s+into\s+({NAME})\s*(\(\s*{NAME}(?:\s*,\s*{NAME})*\s*\))?\s*(values?\b|select\b|with\b)"):
        names = [bare(x) for x in m.group(2).strip("() \n").split(",")] if m.group(2) else None
        return Statement("insert", {"table": bare(m.group(1)), "columns": names, "values": m.group(3).lower().startswith("value"), "source": rewritten(text[m.start(3) :])})
    if m := head(rf"update\s+({NAME})\s+set\s+"):
        rest = text[m.end() :]
        where = find_top(rest, "where")
        sets = [x.partition("=") for x in split_top(rest[:where] if where >= 0 else rest)]
        return Statement("update", {"table": bare(m.group(1)), "set": [(bare(a), rewritten(b)) for a, _, b in sets], "where": rewritten(rest[where + 5 :]) if where >= 0 else None})
    if m := head(rf"delete\s+from\s+({NAME})\b\s*"):
        rest = text[m.end() :]
        where = find_top(rest, "where")
        if where < 0 and rest.strip():
            raise InvalidError(f"cannot read {rest!r}")
        return Statement("delete", {"table": bare(m.group(1)), "where": rewritten(rest[where + 5 :]) if where >= 0 else None})
    if one(r"show\s+(?:full\s+)?tables"):
        return Statement("show_tables")
    if m := one(rf"show\s+(?:index|indexes|keys)\s+(?:from|in)\s+({NAME})"):
        return Statement("show_indexes", {"table": bare(m.group(1))})
    return Statement("query", {"text": rewritten(text)})


def rewritten(text: str) -> str:
    """LIMIT a, b and infix MOD, outside of quotes, as Spark writes them."""
    for pattern, change in ((r"\blimit\s+(\d+)\s*,\s*(\d+)", r"LIMIT \2 OFFSET \1"), (r"(?<=[\w)])\s+mod\s+(?=[\w(])", " % ")):
        plain, at, out = masked(text), 0, []
        for m in re.finditer(pattern, plain, re.I):
            out += [text[at : m.start()], m.expand(change)]
            at = m.end()
        text = "".join(out) + text[at:]
    return text

"""A thin front end for the DML and DDL statements that a branch session accepts.

Statements are cut into clauses here; every expression in them is left to Spark's own parser.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class UnsupportedSQLError(ValueError):
    pass


@dataclass
class Statement:
    kind: str
    table: str = ""
    columns: list[str] = field(default_factory=list)
    where: str | None = None
    sets: dict[str, str] = field(default_factory=dict)
    values: str = ""
    ignore: bool = False
    extra: dict = field(default_factory=dict)


_NAME = r"[`\"]?([A-Za-z_]\w*)[`\"]?"


def split_top(text: str, word: str = ",") -> list[str]:
    """Split at a comma or keyword outside quotes and brackets."""
    parts, depth, quote, begin, i = [], 0, "", 0, 0
    keyword = re.compile(rf"\b{word}\b", re.I) if word != "," else None
    while i < len(text):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif depth == 0:
            m = keyword.match(text, i) if keyword else None
            if c == word or m:
                parts.append(text[begin:i].strip())
                i = m.end() if m else i + 1
                begin = i
                continue
        i += 1
    return [*parts, text[begin:].strip()]


def numbered(sql: str, values: list | tuple) -> tuple[str, dict]:
    """A statement with $1, $2, ... outside quotes as one with named parameters, and those."""
    out, i = [], 0
    for m in re.finditer(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|\$(\d+)", sql):
        if m[1]:
            if not 1 <= int(m[1]) <= len(values):
                raise UnsupportedSQLError(f"no value for ${m[1]}")
            out += [sql[i : m.start()], f":_p{m[1]}"]
            i = m.end()
    named = "".join([*out, sql[i:]])
    return named, {f"_p{k}": v for k, v in enumerate(values, 1) if f":_p{k}" in named}


def parse(sql: str) -> Statement:
    text = sql.strip().rstrip(";").strip()
    head = text.split(None, 1)[0].upper() if text else ""
    if head == "SELECT":
        return Statement("select")
    if head == "WITH":
        raise UnsupportedSQLError("WITH before a write isn't supported")
    if head in ("INSERT", "UPDATE", "DELETE") and len(split_top(text, "RETURNING")) > 1:
        raise UnsupportedSQLError("RETURNING isn't supported")
    if m := re.match(rf"INSERT\s+INTO\s+{_NAME}\s*(\([^)]*\))?\s*(VALUES|SELECT)\b(.*)$", text, re.I | re.S):
        if m[3].upper() == "SELECT":
            raise UnsupportedSQLError("INSERT ... SELECT isn't supported; use insert() with a DataFrame")
        body, *conflict = split_top(m[4], r"ON\s+CONFLICT")
        if conflict and not re.search(r"DO\s+NOTHING\s*$", conflict[0], re.I):
            raise UnsupportedSQLError("only ON CONFLICT DO NOTHING is supported")
        return Statement("insert", m[1], [c.strip(" `\"()") for c in (m[2] or "").split(",") if c.strip(" ()")], values=body, ignore=bool(conflict))
    if m := re.match(rf"UPDATE\s+{_NAME}\s+SET\b(.*)$", text, re.I | re.S):
        sets, *where = split_top(m[2], "WHERE")
        if len(split_top(sets, "FROM")) > 1:
            raise UnsupportedSQLError("UPDATE ... FROM isn't supported")
        pairs = [s.split("=", 1) for s in split_top(sets)]
        return Statement("update", m[1], sets={a.strip(" `\""): b.strip() for a, b in pairs}, where=where[0] if where else None)
    if m := re.match(rf"DELETE\s+FROM\s+{_NAME}\s*(?:WHERE\b(.*))?$", text, re.I | re.S):
        return Statement("delete", m[1], where=m[2])
    if m := re.match(rf"CREATE\s+TABLE\s+{_NAME}\s*\((.*)\)$", text, re.I | re.S):
        cols, pk, defaults = [], [], {}
        for part in split_top(m[2]):
            if k := re.match(r"PRIMARY\s+KEY\s*\((.*)\)", part, re.I):
                pk = [c.strip(" `\"") for c in k[1].split(",")]
                continue
            name, kind, rest = re.match(rf"{_NAME}\s+(\w+(?:\s*\([^)]*\))?)(.*)$", part, re.S).groups()
            cols.append((name, spark_type(kind)))
            if re.search(r"PRIMARY\s+KEY", rest, re.I):
                pk.append(name)
            if d := re.search(r"DEFAULT\s+(.+?)(?:\s+NOT\s+NULL)?$", rest.strip(), re.I):
                defaults[name] = d[1]
        return Statement("create", m[1], extra={"ddl": ", ".join(f"{n} {t}" for n, t in cols), "pk": pk, "defaults": defaults})
    if m := re.match(rf"DROP\s+TABLE\s+{_NAME}$", text, re.I):
        return Statement("drop", m[1])
    if m := re.match(rf"ALTER\s+TABLE\s+{_NAME}\s+ADD\s+COLUMN\s+{_NAME}\s+(\w+(?:\s*\([^)]*\))?)(?:\s+DEFAULT\s+(.+))?$", text, re.I | re.S):
        return Statement("add", m[1], extra={"name": m[2], "type": spark_type(m[3]), "default": m[4]})
    if m := re.match(rf"ALTER\s+TABLE\s+{_NAME}\s+DROP\s+COLUMN\s+{_NAME}$", text, re.I):
        return Statement("drop_column", m[1], extra={"name": m[2]})
    if m := re.match(rf"ALTER\s+TABLE\s+{_NAME}\s+ALTER\s+COLUMN\s+{_NAME}\s+(?:SET\s+DATA\s+)?TYPE\s+(\w+(?:\s*\([^)]*\))?)(?:\s+USING\s+(.+))?$", text, re.I | re.S):
        return Statement("alter_type", m[1], extra={"name": m[2], "type": spark_type(m[3]), "using": m[4]})
    if m := re.match(rf"CREATE\s+INDEX\s+{_NAME}\s+ON\s+{_NAME}\s*\(([^()]*)\)$", text, re.I):
        return Statement("index", m[2], [c.strip(" `\"") for c in m[3].split(",")], extra={"name": m[1]})
    raise UnsupportedSQLError(f"not supported: {text[:80]}")


def spark_type(name: str) -> str:
    # SQL type names and Spark's.
    known = {"int4": "int", "integer": "int", "int8": "bigint", "text": "string", "bool": "boolean", "float8": "double", "bytea": "binary", "blob": "binary", "numeric": "decimal"}
    base, _, args = name.strip().partition("(")
    base = known.get(base.strip().lower(), base.strip().lower())
    return "string" if base == "varchar" else f"{base}({args}" if args else base

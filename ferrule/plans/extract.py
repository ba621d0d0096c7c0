"""Facts from source text. One pass over files yields tagged rows; `facts` splits them in tables.

Python is read with its own parser. C, C++, Java and Go are read by a lexer that knows comments, strings and brackets: declarations behind macros,
overloaded operators and generics in expressions are approximations. A file that can't be read yields an `error` row and never fails the job."""

from __future__ import annotations

from bisect import bisect_right
import ast
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "file_path string, lang string, kind string, seq int, line int, end_line int, name string, value string, owner string, receiver string, args array<string>, params array<string>"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
# Words before a parenthesis that are no calls.
KEYWORDS = set("if for while switch return sizeof catch synchronized func defer go else do case new throw assert elif with print range select".split()) - {"print"}


def split_args(text: str) -> list[str]:
    """Arguments at the top level of brackets and quotes."""
    out, depth, quote, cur = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
            continue
        cur += c
    return [*out, cur.strip()] if cur.strip() or out else []


def python_facts(code: str) -> Iterator[dict]:
    tree = ast.parse(code)
    text = ast.unparse

    def walk(node: ast.AST, owner: str, cls: str) -> Iterator[dict]:
        for child in ast.iter_child_nodes(node):
            line = getattr(child, "lineno", 0)
            here, inside = owner, cls
            if isinstance(child, ast.ClassDef):
                inside = child.name
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                here = f"{cls}.{child.name}" if cls else child.name
                params = [a.arg for a in [*child.args.posonlyargs, *child.args.args, *child.args.kwonlyargs]]
                back = next((text(r.value) for r in ast.walk(child) if isinstance(r, ast.Return) and r.value), None)
                yield {"kind": "function", "line": line, "end_line": child.end_lineno, "name": here, "value": back, "owner": cls, "params": params}
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                base = getattr(child, "module", None)
                for a in child.names:
                    target = f"{base}.{a.name}" if base else a.name
                    yield {"kind": "import", "line": line, "name": a.asname or a.name.split(".")[0] if not base else a.asname or a.name, "value": target if a.asname or base else a.name.split(".")[0]}
            elif isinstance(child, (ast.Assign, ast.AnnAssign)) and child.value is not None:
                for t in child.targets if isinstance(child, ast.Assign) else [child.target]:
                    if isinstance(t, ast.Name) and isinstance(child.value, ast.Lambda):
                        yield {"kind": "function", "line": line, "end_line": child.end_lineno, "name": t.id, "value": text(child.value.body), "owner": cls, "params": [a.arg for a in child.value.args.args]}
                    if isinstance(t, ast.Name):
                        yield {"kind": "assignment", "line": line, "name": t.id, "value": text(child.value), "owner": owner}
                    elif isinstance(t, ast.Attribute):
                        yield {"kind": "field", "line": line, "name": t.attr, "receiver": text(t.value), "value": text(child.value), "owner": owner}
            elif isinstance(child, ast.Call):
                f = child.func
                args = [text(a) for a in child.args] + [f"{k.arg}={text(k.value)}" for k in child.keywords if k.arg]
                to = text(node.targets[0]) if isinstance(node, ast.Assign) and len(node.targets) == 1 else None
                yield {"kind": "call", "line": line, "name": text(f) if isinstance(f, (ast.Name, ast.Attribute)) else "", "receiver": text(f.value) if isinstance(f, ast.Attribute) else None, "value": to, "owner": owner, "args": args}
            elif isinstance(child, ast.Constant) and isinstance(child.value, (int, str, bytes)):
                yield {"kind": "literal", "line": line, "value": repr(child.value), "owner": owner}
            elif isinstance(child, ast.Attribute) and not isinstance(node, ast.Call):
                yield {"kind": "attribute", "line": line, "name": text(child), "owner": owner}
            yield from walk(child, here, inside)

    yield from walk(tree, "", "")


def _blank(code: str) -> str:
    """Comments replaced by blanks; strings and line breaks kept."""
    pattern = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`[^`]*`', re.S)
    return pattern.sub(lambda m: m[0] if m[0][0] in "\"'`" else re.sub(r"[^\n]", " ", m[0]), code)


def _close(code: str, at: int, left: str, right: str) -> int:
    """Place of the bracket that closes the one at `at`, strings aside; len(code) if none does."""
    depth, quote = 0, ""
    for i in range(at, len(code)):
        c = code[i]
        if quote:
            quote = "" if c == quote and code[i - 1] != "\\" else quote
        elif c in "\"'`":
            quote = c
        elif c == left:
            depth += 1
        elif c == right:
            depth -= 1
            if depth == 0:
                return i
    return len(code)


def clike_facts(code: str, lang: str) -> Iterator[dict]:
    code = _blank(code)
    starts = [0] + [m.end() for m in re.finditer("\n", code)]
    line_of = lambda at: bisect_right(starts, at)
    if lang == "go":
        for block in re.finditer(r'import\s*(?:\(([^)]*)\)|((?:\w+\s+)?"[^"]+"))', code):
            for alias, path in re.findall(r'(?:(\w+|\.)\s+)?"([^"]+)"', block[1] or block[2]):
                yield {"kind": "import", "line": line_of(block.start()), "name": alias or path.rsplit("/", 1)[-1], "value": path.replace("/", ".")}
    elif lang == "java":
        for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", code, re.M):
            yield {"kind": "import", "line": line_of(m.start(1)), "name": m[1].rsplit(".", 1)[-1], "value": m[1]}
    else:
        for m in re.finditer(r'^\s*#\s*include\s*[<"]([^>"]+)[>"]', code, re.M):
            yield {"kind": "import", "line": line_of(m.start(1)), "name": re.sub(r"\.h(pp)?$", "", m[1].rsplit("/", 1)[-1]), "value": m[1]}
        for m in re.finditer(r"(?:constexpr|#\s*define)\s+(?:[\w:<>]+\s+)*?(\w+)\s*(?:=\s*)?([\w*+/() ]+?)\s*(?:;|$)", code, re.M):
            yield {"kind": "assignment", "line": line_of(m.start()), "name": m[1], "value": m[2].strip(), "owner": ""}
    owners: list[tuple[int, int, str]] = []
    head = r"\bfunc\s+(?:\(\s*\w+\s+\*?(\w+)\s*\)\s*)?(\w+)\s*\(" if lang == "go" else r"(?:^|[;{}>\s])(?:[\w<>\[\]:*&,]+\s+)+[*&]*((?:\w+::)*)(~?\w+)\s*\("
    for m in re.finditer(head, code):
        if m[2] in KEYWORDS:
            continue
        end = _close(code, m.end() - 1, "(", ")")
        body = re.match(r"[\w\s,.*()\[\]&]*?\{" if lang == "go" else r"\s*(?:const|noexcept|throws\s+[\w.,\s]+)?\s*\{", code[end + 1 : end + 300])
        if not body or re.search(r"\b(?:new|return|else)\s+\S*$", code[max(0, m.start(2) - 12) : m.start(2)]):
            continue
        stop = _close(code, end + body.end(), "{", "}")
        inner = code[end + body.end() + 1 : stop]
        params = [re.split(r"\s+", p)[0] if lang == "go" else re.sub(r"[\[\]*&]", "", re.split(r"[\s*&]+", p.split("=")[0].strip())[-1]) for p in split_args(code[m.end() : end]) if p not in ("", "void")]
        name = ((m[1] or "").rstrip(":") + "." if m[1] else "") + m[2]
        back = re.search(r"\breturn\s+([^;\n]+)", inner)
        owners.append((m.start(2), stop, name))
        yield {"kind": "function", "line": line_of(m.start(2)), "end_line": line_of(min(stop, len(code) - 1)), "name": name, "value": back[1].strip() if back else None, "params": params}
    heads = {a for a, _, _ in owners}

    def owner(at: int) -> str:
        return min(((b - a, n) for a, b, n in owners if a <= at <= b), default=(0, ""))[1]

    for m in re.finditer(r"((?:\bnew\s+)?[A-Za-z_]\w*(?:\s*(?:\.|->|::)\s*[A-Za-z_]\w*)*)\s*\(", code):
        name = re.sub(r"\s+", "", m[1].replace("new ", "")).replace("->", ".")
        tail = re.split(r"\.|::", name)[-1]
        if tail in KEYWORDS or m.start(1) + len(m[1]) - len(tail) in heads:
            continue
        end = _close(code, m.end() - 1, "(", ")")
        left = re.search(r"([A-Za-z_][\w.>-]*)\s*:?=\s*(?:\([\w\s*]+\)\s*)?$", code[max(0, m.start() - 80) : m.start()])
        yield {"kind": "call", "line": line_of(m.start()), "name": name, "receiver": name.rsplit(".", 1)[0] if "." in name else None, "value": left[1] if left else None, "owner": owner(m.start()), "args": split_args(code[m.end() : end])}
    for m in re.finditer(r"\b([A-Za-z_]\w*)((?:(?:\.|->)\w+)*)\s*(?:\[[^\]]*\]\s*)?(:?=)(?!=)\s*([^;\n{]+)", code):
        path = m[2].replace("->", ".")
        row = {"line": line_of(m.start()), "value": m[4].strip(), "owner": owner(m.start())}
        yield row | ({"kind": "field", "receiver": m[1] + path.rsplit(".", 1)[0], "name": path.rsplit(".", 1)[-1]} if path else {"kind": "assignment", "name": m[1]})
    for m in re.finditer(r'"(?:\\.|[^"\\\n])*"|\b\d+\b', code):
        yield {"kind": "literal", "line": line_of(m.start()), "value": m[0], "owner": owner(m.start())}


def file_facts(code: str | None, lang: str, readers: dict[str, Callable[[str], Iterator[dict]]] | None = None) -> Iterator[dict]:
    """Facts of one source. readers: for other languages, or in place of the own ones."""
    try:
        if readers and lang in readers:
            yield from readers[lang](code or "")
        else:
            yield from python_facts(code or "") if lang == "python" else clike_facts(code or "", lang)
    except (SyntaxError, ValueError, RecursionError) as e:
        yield {"kind": "error", "line": getattr(e, "lineno", 0) or 0, "value": type(e).__name__}


def extract(files: DataFrame, readers: dict[str, Callable[[str], Iterator[dict]]] | None = None) -> DataFrame:
    """Tagged fact rows of files(file_path, lang, code); a narrow pass."""
    fields = [(c, pa.list_(pa.string()) if c in ("args", "params") else pa.int32() if c in ("seq", "line", "end_line") else pa.string()) for c in COLUMNS]

    def run(batches):
        held = []
        for batch in batches:
            for path, lang, code in zip(*(c.to_pylist() for c in batch.columns)):
                held += [{"file_path": path, "lang": lang, "seq": i, **row} for i, row in enumerate(file_facts(code, lang, readers))]
                if len(held) >= 5000:
                    yield pa.RecordBatch.from_pylist(held, schema=pa.schema(fields))
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=pa.schema(fields))

    return files.where("code is not null").select("file_path", "lang", "code").mapInArrow(run, SCHEMA)


def facts(rows: DataFrame) -> dict[str, DataFrame]:
    """The fact tables by kind. rows should be written or cached: each table reads them."""
    of = lambda kind, *cols: rows.where(F.col("kind") == kind).select("file_path", "lang", "seq", "line", *cols)
    call_id = F.concat_ws("#", "file_path", "seq").alias("call_id")
    return {
        "functions": of("function", "end_line", "name", F.col("value").alias("return_expression"), F.col("owner").alias("class_name"), F.coalesce("params", F.array().cast("array<string>")).alias("params")),
        "calls": of("call", call_id, F.col("name").alias("symbol"), "receiver", F.col("value").alias("assigned_to"), F.col("owner").alias("owner_function"), F.coalesce("args", F.array().cast("array<string>")).alias("args")),
        "imports": of("import", F.col("name").alias("alias"), F.col("value").alias("target")),
        "assignments": of("assignment", "name", "value", F.col("owner").alias("function")),
        "fields": of("field", "receiver", "name", "value", F.col("owner").alias("function")),
        "literals": of("literal", "value"),
        "attributes": of("attribute", "name"),
        "errors": of("error", "value"),
    }

"""All that the syntax trees of Python files say, from one parse per file in one Arrow job.

A row is a finding of one of four scans, or a string that a decode call takes (``decode-argument``), which
goes down the decode ladder (C20). A file that does not parse, or nests too deep, gives one row ``unparseable``.
"""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_guard.detectors.python_jobs import decode_rescan

ROWS = "repo string, path string, line int, scan string, category string, severity string, detail string"
SHELLS = {"system", "popen", "call", "run", "Popen", "check_output"}
#: The last names of calls that decode their argument.
DECODERS = {"b64decode", "b32decode", "b16decode", "b85decode", "a85decode", "urlsafe_b64decode", "standard_b64decode", "unhexlify", "fromhex", "decode", "decodebytes", "decompress"}
_DECODING = re.compile(r"(b64decode|decode|decompress|fromhex|unhexlify)$")
_FETCHED = re.compile(r"(get|urlopen|read|text)$")
_MILD = {"reload": "high", "bytes-decode": "high"}


def _name(node) -> str:
    if isinstance(node, ast.Attribute):
        return f"{_name(node.value)}.{node.attr}"
    return node.id if isinstance(node, ast.Name) else ""


def _obfuscated(call: ast.Call, name: str) -> str | None:
    """The kind of hidden execution that a call is, if any."""
    first = call.args[0] if call.args else None
    inner = _name(first.func) if isinstance(first, ast.Call) else ""
    if name in ("exec", "eval"):
        if _DECODING.search(inner):
            return "encoded-exec"
        if inner == "compile":
            return "eval-compile"
    if isinstance(call.func, ast.Attribute) and isinstance(call.func.value, ast.Call) and _name(call.func.value.func) == "__import__":
        return "import-call"
    if isinstance(call.func, ast.Call) and _name(call.func.func) == "getattr":
        return "getattr-call"
    if name.split(".")[-1] in SHELLS and isinstance(first, ast.BinOp):
        return "shell-concat"
    if name.endswith("import_module") and first is not None and not isinstance(first, ast.Constant):
        return "computed-import"
    if name.endswith("reload"):
        return "reload"
    if name in ("marshal.loads", "pickle.loads"):
        return "marshal-load"
    if name.endswith(("CodeType", "FunctionType")):
        return "types-code"
    if name == "sys.addaudithook":
        return "audit-hook"
    if name.endswith(".decode") and isinstance(call.func.value, ast.Call) and _name(call.func.value.func) == "bytes":
        return "bytes-decode"
    if name == "open" and isinstance(first, ast.Name) and first.id == "__file__":
        return "self-write"
    return None


def _literals(call: ast.Call):
    for x in [*call.args, *(k.value for k in call.keywords)]:
        if isinstance(x, ast.Constant) and isinstance(x.value, (str, bytes)) and len(x.value) >= 8:
            yield x.value if isinstance(x.value, str) else x.value.decode("latin-1")


def source_rows(source: str) -> list[tuple[int, str, str, str, str]]:
    """(line, scan, category, severity, detail) of one file."""
    try:
        tree = ast.parse(source)
        nodes = list(ast.walk(tree))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [(0, "ast", "unparseable", "low", "")]
    out = []
    for node in nodes:
        if isinstance(node, ast.Call):
            name = _name(node.func)
            if kind := _obfuscated(node, name):
                out.append((node.lineno, "ast", kind, _MILD.get(kind, "critical"), ""))
            first = node.args[0] if node.args else None
            if name in ("__import__", "importlib.import_module") and first is not None and not isinstance(first, ast.Constant):
                out.append((node.lineno, "dynamism", "dynamic-import", "high", ""))
            if name in ("eval", "exec") and isinstance(first, ast.Call) and _FETCHED.search(_name(first.func)):
                out.append((node.lineno, "dynamism", "fetch-execute", "critical", ""))
            last = node.func.attr if isinstance(node.func, ast.Attribute) else name
            if last in DECODERS:
                inside = [*_literals(node)]
                if isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Constant) and isinstance(node.func.value.value, (str, bytes)):
                    value = node.func.value.value
                    inside.append(value if isinstance(value, str) else value.decode("latin-1"))
                out += [(node.lineno, "literal", "decode-argument", "info", x) for x in inside]
        elif isinstance(node, ast.FunctionDef) and node.name == "__reduce__":
            out.append((node.lineno, "ast", "reduce", "critical", ""))
        elif isinstance(node, ast.Compare) and any("now" in _name(x.func) for x in ast.walk(node) if isinstance(x, ast.Call)):
            out.append((node.lineno, "dynamism", "time-bomb", "medium", ""))
        elif isinstance(node, ast.Try) and any(isinstance(x, (ast.Import, ast.ImportFrom)) for x in node.body):
            if any(isinstance(x, ast.Constant) and x.value == "install" or isinstance(x, ast.Attribute) and x.attr == "main" for h in node.handlers for x in ast.walk(h)):
                out.append((node.lineno, "fallback", "import-else-install", "high", ""))
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.ClassDef, ast.AsyncFunctionDef)) or (isinstance(node, ast.If) and "__name__" in ast.dump(node.test)):
            continue
        for call in (x for x in ast.walk(node) if isinstance(x, ast.Call)):
            name = _name(call.func)
            if name in ("eval", "exec") or name.startswith(("os.system", "subprocess.", "requests.", "urllib.")):
                out.append((call.lineno, "entry", "entrypoint-import-exec", "critical" if name in ("eval", "exec") else "high", ""))
    return out


def parse_python(files: DataFrame) -> DataFrame:
    """All rows of the Python files among files(repo, path, ext, content), each parsed once."""

    def work(batches):
        for batch in batches:
            out = [(r, p, *row) for r, p, text in zip(*(batch.column(c).to_pylist() for c in ("repo", "path", "content"))) for row in source_rows(text or "")]
            if out:
                kinds = (pa.string(), pa.string(), pa.int32(), *[pa.string()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["repo", "path", "line", "scan", "category", "severity", "detail"])

    return files.where("ext = 'py'").select("repo", "path", "content").mapInArrow(work, ROWS)


def of_scan(rows: DataFrame, scan: str) -> DataFrame:
    """The findings of one scan among the rows of ``parse_python``."""
    return rows.where(F.col("scan") == scan).select("repo", "path", "line", "category", "severity")


def decoded_arguments(rows: DataFrame) -> DataFrame:
    """C50 into C20: dangerous calls in what the arguments of decode calls decode to."""
    blobs = rows.where("scan = 'literal'").select("repo", "path", F.regexp_replace("detail", r"\s", "").alias("blob")).distinct()
    return decode_rescan(blobs)

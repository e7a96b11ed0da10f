"""Detectors that need a parser, a decoder or the order of lines, as Spark jobs over rows."""

from __future__ import annotations

import ast
import base64
import binascii
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- decoding ---------------------------------------------------------------------------------------------------------------


_DECODERS = (("hex", binascii.unhexlify), ("base64", lambda x: base64.b64decode(x, validate=True)), ("base32", base64.b32decode), ("base85", base64.b85decode))


def _printable(text: str) -> int:
    return sum(c.isprintable() or c in "\t\r\n" for c in text)


def _decode(blob: str) -> list[tuple[str, str]]:
    out = []
    for name, fn in _DECODERS:
        try:
            text = fn(blob).decode("utf-8")
        except (ValueError, binascii.Error):
            continue
        if text and _printable(text) / len(text) >= 0.85:
            out.append((name, text))
    return out[:2]


def _inside(data: bytes) -> int:
    """The number of leading bytes that belong to a character begun before."""
    return next((i for i, b in enumerate(data) if b & 0xC0 != 0x80), len(data))


def decodes_in_part(own: str, ahead: str, first: bool) -> list[tuple[str, int, int]]:
    """The decoders that take a part of a blob, with the characters that begin in it and the printable ones among them.

    Parts begin at multiples of 40 characters, where no decoder is inside a group; ``ahead`` is what follows, 40 characters or
    the rest. A blob decodes as a whole where all its parts do: what a part leaves to the last character of the one before is what that takes.
    """
    out = []
    for name, fn in _DECODERS:
        if ahead and own.endswith("=") and name in ("base64", "base32"):
            continue
        try:
            data, rest = fn(own), fn(ahead) if ahead else b""
            text = (data[0 if first else _inside(data) :] + rest[: _inside(rest)]).decode("utf-8")
        except (ValueError, binascii.Error):
            continue
        out.append((name, len(text), _printable(text)))
    return out


_DANGER = re.compile(r"(eval\s*\(|exec\s*\(|child_process|os\.system|subprocess|curl\s|wget\s|/dev/tcp|process\.env|\.ssh/|console\.log\()")
_BLOB = re.compile(r"[A-Za-z0-9+/]{24,}={0,2}|[0-9a-fA-F]{48,}")


#: Signs that count only in text that parses as a program: prose that mentions them does not.
_IN_CODE = re.compile(
    r"""getattr\s*\(\s*[\w.]+\s*,[^)]*\)\s*\(|urllib\.request|http\.client|shutil\.rmtree\s*\(|os\.(?:remove|unlink)\s*\(|Popen\s*\(|__import__\s*\(|open\s*\(\s*['"][^'"]*(?:/etc/(?:passwd|shadow)|\.ssh/|\.aws/|\.env)"""
)


def code_like(text: str) -> bool:
    """Whether text parses as Python statements other than names and constants alone."""
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return any(not (isinstance(x, ast.Expr) and isinstance(x.value, (ast.Name, ast.Constant))) for x in body)


def dangerous(text: str) -> str | None:
    """What a decoded text calls: a sign that counts anywhere, or one that counts in programs."""
    if m := _DANGER.search(text):
        return m[0]
    m = _IN_CODE.search(text)
    return m[0] if m and code_like(text) else None


def decode_rescan(blobs: DataFrame, layers: int = 3) -> DataFrame:
    """C20: blobs(repo, path, blob) decoded strictly through at most ``layers`` layers; dangerous calls in what comes out."""

    # by rows, not in Arrow batches of thousands of rows: a blob may have a million characters
    @F.udf("array<struct<depth:int,trail:string,call:string>>", useArrow=False)
    def decoded(blob):
        out, level = [], [("", blob)]
        for depth in range(1, layers + 1):
            nxt = []
            for trail, b in level:
                for name, text in _decode(b):
                    here = f"{trail}>{name}" if trail else name
                    if call := dangerous(text):
                        out.append((depth, here, call))
                    nxt += [(here, x) for x in _BLOB.findall(text)]
            level = nxt
        return out

    return blobs.select("repo", "path", F.explode(decoded("blob")).alias("d")).select("repo", "path", "d.*").distinct()


# ---- split fragments ----------------------------------------------------------------------------------------------------------

_FRAGMENT = r"['\"]([A-Za-z0-9+/=]{6,200})['\"]"


def fragments(files: DataFrame) -> DataFrame:
    """Quoted fragments per file in order, longest spans first without overlap, distinct."""
    found = files.select("repo", "path", F.posexplode(F.regexp_extract_all("content", F.lit(_FRAGMENT), 1)).alias("ord", "frag"))
    return found.groupBy("repo", "path", "frag").agg(F.min("ord").alias("ord"))


# ---- binaries ------------------------------------------------------------------------------------------------------

#: Magic bytes and the kind they mean.
MAGIC = (("7f454c46", "elf"), ("4d5a", "pe"), ("cafebabe", "java"), ("feedface", "macho"), ("504b0304", "zip"), ("1f8b", "gzip"), ("25504446", "pdf"))
SAFE_EXT = ("txt", "md", "json", "yml", "yaml", "csv", "png", "jpg", "svg", "css", "html")


def scan_magic(files: DataFrame) -> DataFrame:
    """files(path, ext, bytes) with a harmless extension whose first bytes are those of a program or archive."""
    head = F.lower(F.hex(F.substring("bytes", 1, 4)))
    kind = F.coalesce(*[F.when(head.startswith(m), F.lit(k)) for m, k in MAGIC])
    return files.where(F.col("ext").isin(*SAFE_EXT)).withColumn("kind", kind).where("kind is not null").select("path", "ext", "kind")


def scan_embedded(files: DataFrame, window: int = 128 * 1024) -> DataFrame:
    """A program header inside the first ``window`` bytes of another file, and text hidden in audio files."""
    head = F.substring("bytes", 1, window)
    at = F.instr(F.hex(head), F.lit("4D5A9000"))
    kind = F.when((at > 1) & (at % 2 == 1), "embedded-program").when(F.col("ext").isin("wav", "mp3") & F.hex(head).rlike("(2[0-9A-F]|[3-7][0-9A-F]){200,}"), "audio-payload")
    return files.withColumn("kind", kind).where("kind is not null").select("path", "ext", "kind")


def archive_kind(files: DataFrame) -> DataFrame:
    """The kind of an archive by extension or magic; unsupported kinds are low, office documents with a program inside are found with A21."""
    head = F.lower(F.hex(F.substring("bytes", 1, 6)))
    by_ext = F.when(F.col("ext").isin("zip", "whl", "jar", "docx", "xlsx", "pptx"), "zip").when(F.col("ext").isin("tar", "gz", "tgz"), "tar").when(F.col("ext").isin("7z", "rar"), "unsupported")
    by_magic = F.when(head.startswith("504b0304"), "zip").when(head.startswith("1f8b"), "tar").when(head.startswith("377abcaf") | head.startswith("52617221"), "unsupported")
    return files.withColumn("kind", F.coalesce(by_magic, by_ext)).where("kind is not null").select("path", "kind", F.when(F.col("kind") == "unsupported", "low").otherwise("info").alias("severity"))

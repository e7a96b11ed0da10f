"""Scalar functions on columns."""

from __future__ import annotations

import difflib
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_guard.operators.lines import glob_to_regex, stripped
from corpus_guard.schema import BLOCK_AT, CONFIDENCE, INFO_AT, SEVERITY, WARN_AT

__all__ = ["glob_to_regex"]


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def severity_score(sev: str | Column) -> Column:
    """4 to 1; unknown severities score 0."""
    return F.coalesce(*[F.when(F.lower(sev) == s, F.lit(n)) for s, n in SEVERITY.items()], F.lit(0))


def default_confidence(sev: str | Column) -> Column:
    return F.coalesce(*[F.when(F.lower(sev) == s, F.lit(n)) for s, n in CONFIDENCE.items()], F.lit(CONFIDENCE["low"]))


def verdict_tier(confidence: str | Column) -> Column:
    """Block, warn, info or suppressed by confidence."""
    c = _col(confidence)
    return F.when(c >= BLOCK_AT, "block").when(c >= WARN_AT, "warn").when(c >= INFO_AT, "info").otherwise("noise")


#: Release part, then pre-release; build metadata is dropped.
_VERSION = r"^[vV=]?\s*(\d+)(?:\.(\d+))?(?:\.(\d+))?((?:\.\d+)*)([-.]?(?:a|b|c|rc|alpha|beta|pre|dev|post)[-.]?\d*[0-9A-Za-z.-]*|-[0-9A-Za-z][0-9A-Za-z.-]*)?(?:\+[0-9A-Za-z.-]+)?$"


def normalize_version(v: str | Column, strict_pin: bool = False) -> Column:
    """A version without marks, leading zeros and build metadata; null for control characters, exclusions and (strict) ranges."""
    raw = stripped(v)
    bad = raw.rlike(r"[\x00-\x1f\x7f]") | raw.rlike(r"!=|!==|\bnot\b|^<")
    if strict_pin:
        bad = bad | raw.rlike(r"[\^~<>*|xX ]|^>=| - |,")
    core = F.regexp_replace(raw, r"^(===|==|~=|>=|\^|~|=)\s*", "")
    part = lambda i: F.regexp_extract(core, _VERSION, i)
    num = lambda i: F.coalesce(F.when(part(i) != "", part(i).cast("bigint").cast("string")), F.lit("0"))
    out = F.concat(num(1), F.lit("."), num(2), F.lit("."), num(3), part(4), F.lower(F.regexp_replace(part(5), r"^[-.]", "-")))
    return F.when(~bad & core.rlike(_VERSION), out)


def canonical_package(ecosystem: str | Column, name: str | Column) -> Column:
    """Runs of - _ . become one - for PyPI; lower case for all."""
    low = F.lower(stripped(name))
    return F.when(_col(ecosystem) == "pypi", F.regexp_replace(low, r"[-_.]+", "-")).otherwise(low)


def strip_package_version(spec: str | Column) -> Column:
    """I4: the name of a specifier; a leading scope stays."""
    return F.regexp_replace(F.regexp_replace(spec, r"(.)@.*$", "$1"), r"\s*(===?|>=|<=|~=|!=|>|<|\[|;).*$", "")


def l33t_normalize(s: str | Column) -> Column:
    """I5."""
    return F.translate(s, "013@", "olea")


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def sequence_ratio(a: str | Column, b: str | Column) -> Column:
    """difflib's ratio; use over distinct pairs only."""
    return _ratio(a, b)


MULTI_PART = ("co.uk", "com.au", "co.jp", "com.br", "co.nz", "org.uk", "github.io", "co.in")
CLOUD_SUFFIXES = ("s3.amazonaws.com", "herokuapp.com", "azurewebsites.net", "github.io", "netlify.app", "vercel.app", "pages.dev", "firebaseapp.com", "blob.core.windows.net")


def registrable_domain(host: str | Column) -> Column:
    """The last two labels, three under a multi-part suffix; null for addresses and bare names."""
    labels = F.split(F.lower(host), r"\.")
    n = F.size(labels)
    two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), 3), ".")
    return F.when(_col(host).rlike(r"^[0-9.]+$") | (n < 2), F.lit(None)).when(two.isin(*MULTI_PART) & (n >= 3), three).otherwise(two)


def cloud_suffix(host: str | Column) -> Column:
    h = F.lower(host)
    return F.coalesce(*[F.when(h.endswith("." + s), F.lit(s)) for s in CLOUD_SUFFIXES])


def url_host(url: str | Column) -> Column:
    """I8: host of a URL in lower case, null if it is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@\s]*@)?([A-Za-z0-9.-]+)", 1)), F.lit(""))


def sanitize_text(s: str | Column, n: int = 200) -> Column:
    """No ANSI codes, controls, bidirectional or zero-width marks and backticks; runs of white space become one space; cut."""
    out = F.regexp_replace(s, r"\x1b\[[0-9;]*[A-Za-z]", "")
    out = F.regexp_replace(out, r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2069}\x{feff}`]", "")
    out = F.regexp_replace(out, r"[\x00-\x1f\x7f]+", " ")
    return F.substring(F.trim(F.regexp_replace(out, r" +", " ")), 1, n)


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).lower())


def nfkc_lower(s: str | Column) -> Column:
    """NFKC and lower case; text in ASCII stays in the JVM."""
    plain = ~_col(s).rlike(r"[^\x00-\x7f]")
    return F.when(plain, F.lower(s)).otherwise(_nfkc(F.when(~plain, _col(s))))


def printable_ratio(s: str | Column) -> Column:
    """Share of characters that are printable ASCII or white space."""
    return F.length(F.regexp_replace(s, r"[^\x20-\x7e\t\n\r]", "")) / F.nullif(F.length(s), F.lit(0))


def sha256(s: str | Column) -> Column:
    """I12."""
    return F.sha2(s, 256)


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON of the fields in order of their names; nulls are kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def cvss_score(text: str | Column) -> Column:
    """The first number, if between 0 and 10."""
    x = F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when((x >= 0) & (x <= 10), x)


def strip_shell_comment(line: str | Column) -> Column:
    """Cut at a # that follows white space or starts the line, outside quotes. Possessive groups keep long lines off the stack."""
    return F.regexp_replace(F.regexp_extract(line, r"""^((?:'[^']*'|"(?:\\.|[^"\\])*+"|[^'"#\s]#*|\s+(?!#)|['"])*+)""", 1), r"\s+$", "")


def alphabet_of(fragment: str | Column) -> Column:
    """The narrowest alphabet that holds the fragment."""
    f = _col(fragment)
    return F.when(f.rlike(r"^[0-9a-fA-F]+$"), "hex").when(f.rlike(r"^[A-Z2-7]+=*$"), "base32").when(f.rlike(r"^[A-Za-z0-9+/_-]+=*$"), "base64").when(f.rlike(r"^[!-u]+$"), "base85")


ECOSYSTEMS = ("npm", "pypi", "go", "crates", "maven", "rubygems")


def input_valid(ecosystem: str | Column, name: str | Column, version: str | Column) -> Column:
    """Whether a lookup may be made: known ecosystem, plain name and version."""
    return F.coalesce(
        _col(ecosystem).isin(*ECOSYSTEMS) & _col(name).rlike(r"^(@[a-z0-9~][a-z0-9._~-]*/)?[A-Za-z0-9][A-Za-z0-9._-]{0,127}$") & _col(version).rlike(r"^[A-Za-z0-9][A-Za-z0-9.+_-]{0,63}$"), F.lit(False)
    )


BIDI = r"[\x{202a}-\x{202e}\x{2066}-\x{2069}\x{200e}\x{200f}]"


def has_bidi(path: str | Column) -> Column:
    """Bidirectional marks in a path, for rejecting it."""
    return _col(path).rlike(BIDI)


def dotted_get(json: str | Column, path: str) -> Column:
    """The text at a dotted path of JSON, null if absent or not JSON."""
    return F.try_variant_get(F.try_parse_json(_col(json)), "$." + path, "string")


def looks_like_llm_bait(name: str | Column) -> Column:
    """Buzzword names."""
    return F.lower(name).rlike(r"(^|[-_])(ai|gpt|llm|agent|copilot|chatbot|rag|mcp)([-_]|$)")


@F.arrow_udf(T.DoubleType())
def _entropy(texts: pa.Array) -> pa.Array:
    """Counts of the code points of all texts of a batch by one sort for about a million characters at a time."""
    out = np.zeros(len(texts))
    held, at, size = [], [], 0

    def flush():
        n = np.array([len(t) for t in held])
        points = np.frombuffer("".join(held).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        key = (np.repeat(np.arange(len(held), dtype=np.uint64), n) << np.uint64(21)) | points
        found, count = np.unique(key, return_counts=True)
        row = (found >> np.uint64(21)).astype(np.int64)
        share = count / n[row]
        out[at] = np.bincount(row, -share * np.log2(share), len(held))

    for i, t in enumerate(texts):
        text = t.as_py() or ""
        if text:
            held.append(text)
            at.append(i)
            size += len(text)
        if size > 1 << 20:
            flush()
            held, at, size = [], [], 0
    if held:
        flush()
    return pa.array(out, mask=texts.is_null().to_numpy(zero_copy_only=False))


def entropy(s: str | Column) -> Column:
    """Shannon entropy in bits per character of the whole string; 0 for the empty string."""
    return _entropy(_col(s))

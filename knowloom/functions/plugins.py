"""Extension points: extractor, embedder, answerer, rich-text reader. Defaults are deterministic and need no service."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf


def extractor(fn: Callable[[str], str] | None = None):
    """Chunk text to the JSON of its entities and relations. Default: capitalised words, each related to the next."""
    import json

    def default(text: str) -> str:
        names = list(dict.fromkeys(re.findall(r"\b[A-Z][A-Za-z0-9]{2,}\b", text)))
        return json.dumps({"entities": [{"name": n} for n in names], "relations": [{"head": a, "tail": b} for a, b in zip(names, names[1:])]})

    f = fn or default

    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: f(t) if t else '{"entities":[],"relations":[]}')

    return run


def hashed_embedding(text: str | None, dims: int = 64) -> np.ndarray:
    v = np.zeros(dims, np.float32)
    for w in re.findall(r"\w+", (text or "").lower()):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % dims] += 1.0 if h >> 63 else -1.0
    n = float(np.linalg.norm(v))
    return v / n if n else v


def embedder(fn: Callable[[list[str]], list] | None = None, dims: int = 64):
    """Texts to vectors, a batch at a time. Default: hashed words."""

    @pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(fn(s.tolist())) if fn else [hashed_embedding(t, dims) for t in s], index=s.index)

    return run


def answerer(fn: Callable[[str], str] | None = None):
    """Prompt to answer. Default: the first context's text, or an empty answer."""

    def default(prompt: str) -> str:
        m = re.search(r"\[Source 1: [^\n]*\]\n(.*?)(?:\n\n|$)", prompt, re.S)
        return m.group(1) if m else ""

    f = fn or default

    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: f(t) if t else "")

    return run


def html_text(c):
    """Plain text of HTML with JVM expressions: scripts, styles, tags and common entities removed."""
    t = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr)[^>]*>", "\n"), r"<[^>]+>", "")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def rich_text(fn: Callable[[bytes, str], str] | None = None):
    """(content, path) to text; whatever fails falls back to the raw bytes as UTF-8. Texts are whole, however long."""

    @pandas_udf("string")
    def run(content: pd.Series, path: pd.Series) -> pd.Series:
        def one(raw, p):
            if raw is None:
                return None
            try:
                text = fn(bytes(raw), p) if fn else None
                return text if isinstance(text, str) else bytes(raw).decode("utf-8", "replace")
            except Exception:  # noqa: BLE001
                return bytes(raw).decode("utf-8", "replace")

        return pd.Series([one(r, p) for r, p in zip(content, path)])

    return run

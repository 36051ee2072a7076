"""Text, identity and keyword expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the identity, type and key rules must equal.
ID_HEX = 16
TYPE_SUFFIXES = {"pdf": [".pdf"], "image": [".png", ".jpg", ".jpeg"], "table": [".csv", ".xlsx"], "markdown": [".md"]}
RELATIONSHIP_MARKERS = ["关系", "关联", "属于", "依赖", "合作", "哪家公司", "relationship", "depends on"]
DEFAULT_CHUNK, DEFAULT_OVERLAP = 512, 64
FIRST_KEYWORD_CHARS, MAX_KEYWORDS, MAX_NGRAMS = 20, 8, 6

#: Characters up to U+0020, which the chunker's trim removes.
CTRL_TRIM = r"^[\x00-\x20]+|[\x00-\x20]+$"
#: White space of any kind, Unicode's included.
ANY_WS = r"(?U)^\s+|\s+$"


def strip_ws(c: Column) -> Column:
    """Remove white space of any kind (tabs, line ends, Unicode spaces) around a string; null stays null."""
    return F.regexp_replace(c, ANY_WS, "")


def strip_ctrl(c: Column) -> Column:
    """Remove all characters up to U+0020 around a string."""
    return F.regexp_replace(c, CTRL_TRIM, "")


def norm_token(c: Column) -> Column:
    """White space around it and letter case do not matter; blank becomes null."""
    s = F.lower(strip_ws(c))
    return F.when(s != "", s)


def doc_identity(path: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the path; null for a null path."""
    return F.substring(F.sha2(path, 256), 1, ID_HEX)


def doc_type(path: Column) -> Column:
    """pdf, image, table, markdown or text by the lower-cased suffix; a null path is text."""
    p = F.lower(path)
    out = F
    for kind, ends in TYPE_SUFFIXES.items():
        cond = F.lit(False)
        for e in ends:
            cond = cond | p.endswith(e)
        out = out.when(cond, kind)
    return out.otherwise("text")


def content_hash(content: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the content; null content hashes the word null."""
    return F.substring(F.sha2(F.coalesce(content, F.lit("null")), 256), 1, ID_HEX)


def fingerprint(doc_id: Column, index: Column, content: Column) -> Column:
    """doc_id::chunk_index::content_hash, with nulls printed as the word null."""
    word = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    return F.concat_ws("::", word(doc_id), word(index), content_hash(content))


def key_part(c: Column) -> Column:
    """Graph key normalisation: blank is `unknown`; other runs than Han, a-z and 0-9 become one underscore."""
    t = strip_ctrl(c)
    return F.when(t.isNull() | (t == ""), F.lit("unknown")).otherwise(F.regexp_replace(F.lower(t), r"[^\p{IsHan}a-z0-9]+", "_"))


def trimmed_key_part(c: Column) -> Column:
    """As key_part, with underscores at the ends removed."""
    return F.regexp_replace(key_part(c), r"^_+|_+$", "")


def entity_key(name: Column, source: Column) -> Column:
    return F.concat_ws("::", key_part(source), key_part(name))


def relation_type(c: Column) -> Column:
    return F.upper(F.replace(c, F.lit(" "), F.lit("_")))


def contains_han(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\p{IsHan}"), F.lit(False))


def _grams(token: Column, n: int) -> Column:
    return F.when(F.length(token) >= n, F.transform(F.sequence(F.lit(1), F.length(token) - (n - 1)), lambda i: F.substring(token, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def expand_han_token(token: Column) -> Column:
    """Two-grams from left to right, then three-grams; six in total at most."""
    return F.slice(F.concat(_grams(token, 2), _grams(token, 3)), 1, MAX_NGRAMS)


def candidate_keywords(question: Column) -> Column:
    """Ordered distinct keywords of a question, eight at most; a blank or null question has none."""
    q = strip_ctrl(F.coalesce(question, F.lit("")))
    tokens = F.regexp_extract_all(q, F.lit(r"([\p{IsHan}A-Za-z0-9_]{2,20})"), 1)
    with_grams = F.transform(tokens, lambda t: F.concat(F.array(t), F.when(contains_han(t) & (F.length(t) > 4), expand_han_token(t)).otherwise(F.array().cast("array<string>"))))
    words = F.concat(F.array(F.substring(q, 1, FIRST_KEYWORD_CHARS)), F.flatten(with_grams))
    return F.when(q == "", F.array().cast("array<string>")).otherwise(F.slice(F.array_distinct(words), 1, MAX_KEYWORDS))


def question_mode(question: Column) -> Column:
    """RELATIONSHIP if the lower-cased question contains a marker, else DESCRIPTIVE (also for blank and null)."""
    q = F.lower(F.coalesce(question, F.lit("")))
    cond = F.lit(False)
    for m in RELATIONSHIP_MARKERS:
        cond = cond | q.contains(m)
    return F.when(cond, "RELATIONSHIP").otherwise("DESCRIPTIVE")


def normalize_message(content: Column, max_chars: int = 300) -> Column:
    """White space runs to one space, trimmed, cut at max_chars with `...`; null is empty."""
    t = F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), r"[\s\x0B]+", " "))
    return F.when(F.length(t) > max_chars, F.concat(F.substring(t, 1, max_chars), F.lit("..."))).otherwise(t)


def graph_context_text(source: Column, relations: Column, target: Column, target_type: Column) -> Column:
    return F.concat(source, F.lit(" --["), F.array_join(relations, " -> "), F.lit("]--> "), target, F.lit(" ("), target_type, F.lit(")"))


def blank_to_null(c: Column) -> Column:
    t = strip_ctrl(c)
    return F.when(t != "", t)

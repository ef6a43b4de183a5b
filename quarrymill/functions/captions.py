"""Caption texts as column expressions: cleaning, editing, issues, score."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from py4j.protocol import Py4JError
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"(?U)\s"
MOST_PATTERN = 500


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize(text: Column) -> Column:
    """Stripped; runs of spaces one space; runs of commas one; no space before a comma, one after; no comma at the end."""
    t = F.regexp_replace(strip(text), "  +", " ")
    t = F.regexp_replace(t, r"(?U),\s*,+", ",")
    t = F.regexp_replace(t, r"(?U)\s+,", ",")
    t = F.regexp_replace(t, r"(?U),(?!\s)", ", ")
    return F.regexp_replace(t, r"[, ]+$", "")


def prepend(text: Column, prefix: str) -> Column:
    return strip(F.concat(F.lit(prefix if prefix.endswith(" ") else prefix + " "), text))


def append(text: Column, suffix: str) -> Column:
    """Joined by a comma and a space, or by a space alone after a comma."""
    bare = F.regexp_replace(text, r"(?U)\s+$", "")
    return F.concat(bare, F.when(F.endswith(bare, F.lit(",")), " ").otherwise(", "), F.lit(suffix))


def java_pattern(find: str) -> str | None:
    """A regular expression in Java's dialect: named groups and references to them are written otherwise there. None if
    Python or Java does not know it, or if it has more than MOST_PATTERN characters."""
    if len(find) > MOST_PATTERN:
        return None
    try:
        re.compile(find)
    except re.error:
        return None
    plain = lambda name: name.replace("_", "X")  # noqa: E731 - Java's names have letters and digits only
    java, at = [], 0
    for m in re.finditer(r"\\.|\(\?P<(\w+)>|\(\?P=(\w+)\)", find, re.S):
        java.append(find[at : m.start()])
        java.append(f"(?<{plain(m[1])}>" if m[1] else rf"\k<{plain(m[2])}>" if m[2] else r"\z" if m[0] == r"\Z" else m[0])
        at = m.end()
    made = "".join([*java, find[at:]])
    session = SparkSession.active()
    try:
        session._jvm.java.util.regex.Pattern.compile(made)
    except Py4JError:
        return None
    return made


def find_replace(text: Column, find: str, new: str, regex: bool = False) -> Column:
    """Literal or regular expression of Python's (\\1 and \\g<name> name a group, all else stands for itself).

    A pattern that is no regular expression, or that is too long or unknown to the engine, changes nothing: callers see
    their rows unaffected.
    """
    if not regex:
        return F.replace(text, F.lit(find), F.lit(new))
    if (made := java_pattern(find)) is None:
        return text
    compiled = re.compile(find)
    # Java's replacement gives "$" and "\\" a meaning; only groups keep theirs
    parts = re.split(r"\\(\d)|\\g<(\w+)>", new)
    out = []
    for plain, digit, name in zip(parts[::3], [*parts[1::3], None], [*parts[2::3], None], strict=True):
        out.append(plain.replace("\\", "\\\\").replace("$", "\\$"))
        if digit or name:
            group = int(digit or (name if name.isdigit() else compiled.groupindex.get(name, -1)))
            if not (0 if name else 1) <= group <= compiled.groups:
                return text
            out.append(f"${group}")
    # a digit behind a group's number would be read as one of its digits
    java = "".join("\\" + o if k and k % 2 == 0 and o[:1].isdigit() else o for k, o in enumerate(out))
    return F.regexp_replace(text, F.lit(made), F.lit(java))


def issues(text: Column) -> dict[str, Column]:
    n = F.length(text)
    return {"edge_space": text != strip(text), "double_space": F.contains(text, F.lit("  ")), "double_comma": F.regexp_like(text, F.lit(r"(?U),\s*,")), "too_short": n < 10, "too_long": n > 800}


#: The patterns of facial descriptions, in order.
FACIAL = (
    r"\b(with\s+)?(brown|blue|green|hazel|dark|light|bright)\s+eyes\b",
    r"\b(with\s+)?(long|short|curly|straight|wavy|blonde|brunette|dark|red|black|brown)\s+(hair|locks|curls)\b",
    r"\b(with\s+)?(a\s+)?(small|large|button|straight|pointed|wide|narrow)\s+nose\b",
    r"\b(with\s+)?(full|thin|pouty|pink|red)\s+lips\b",
    r"\b(with\s+)?(high|prominent|defined)\s+cheekbones\b",
    r"\b(with\s+)?(a\s+)?(strong|square|round|oval|defined)\s+(jaw|jawline|chin)\b",
    r"\b(with\s+)?(smooth|clear|fair|tan|olive|pale|dark)\s+skin\b",
    r"\b(with\s+)?(a\s+)?(beautiful|attractive|handsome|pretty|young|old)\s+face\b",
    r"\bfacial\s+features?\b",
    r"\b(his|her|their)\s+face\s+(is|looks|appears)\b[^.]*\.",
)


def strip_facial_terms(text: Column) -> Column:
    for pattern in FACIAL:
        text = F.regexp_replace(text, "(?i)" + pattern, "")
    text = F.regexp_replace(text, r"\s*,\s*,", ",")
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"^[,.\s]+", "")


#: The word lists of the caption score.
FACIAL_WORDS = ("eyes", "hair", "nose", "lips", "mouth", "chin", "jaw", "cheekbones", "eyebrows", "eyelashes", "forehead", "freckles", "complexion", "skin tone", "facial features", "face shape")
STOP_WORDS = ("a", "an", "the", "is", "are", "was", "were", "in", "on", "at", "to", "of", "and", "or", "with", "that", "this", "for", "by", "from", "as", "it", "be")
ELEMENTS = {
    "pose": ("standing", "sitting", "walking", "posing", "leaning", "looking", "facing", "turned", "portrait", "headshot"),
    "clothing": ("wearing", "dressed", "shirt", "dress", "suit", "jacket", "coat", "top", "pants", "jeans", "outfit"),
    "setting": ("background", "studio", "outdoors", "indoor", "room", "street", "garden", "office", "beach", "urban", "nature"),
}


#: What the caption score counts of a text: words, distinct content words, how often the most frequent one comes, and
#: whether it has words of the lists.
COUNTED = T.StructType([T.StructField(n, T.IntegerType()) for n in ("words", "unique", "most")] + [T.StructField(n, T.BooleanType()) for n in ("facial", *ELEMENTS)])
BLANKS, MARKS = re.compile(r"[ \t\n\x0b\f\r]+"), ".,!?;:"


@F.pandas_udf(COUNTED)
def counted(lower: pd.Series) -> pd.DataFrame:
    """COUNTED of lower-case texts, in one pass over each; null for null."""
    stop, rows = set(STOP_WORDS), []
    for text in lower:
        if text is None:
            rows.append((None,) * len(COUNTED))
            continue
        words = [w for w in BLANKS.split(text) if w]
        content = Counter(w for w in (w.strip(MARKS) for w in words) if w not in stop)
        rows.append((len(words), len(content), max(content.values(), default=0), any(w in text for w in FACIAL_WORDS), *(any(w in text for w in some) for some in ELEMENTS.values())))
    return pd.DataFrame(rows, columns=COUNTED.names).astype({f.name: "Int32" if isinstance(f.dataType, T.IntegerType) else "boolean" for f in COUNTED})


def caption_score(text: Column, style: str = "moderate", trigger: str = "", has_face: bool = True) -> Column:
    """Struct of score (0 to 100), grade, words and unique content words. Styles: minimal, moderate, rich.

    The words are counted once a text, in Arrow batches: as columns they would be split anew at each use.
    """
    lower = F.lower(strip(text))
    x = counted(lower)
    n, unique, repeat = x["words"], x["unique"], x["most"]
    length = {"minimal": F.when(n > 40, 10).when(n < 5, 20), "rich": F.when(n < 15, 10)}.get(style, F.when(n < 8, 10).when(n > 80, 5))
    loss = F.coalesce(length, F.lit(0))
    if has_face and style == "minimal":
        loss = loss + F.when(x["facial"], 20).otherwise(0)
    if trigger:
        loss = loss + F.when(F.startswith(lower, F.lit(trigger.lower())), 0).otherwise(15)
    loss = loss + F.when(unique / F.greatest(n, F.lit(1)) < 0.3, 5).otherwise(0)
    loss = loss + F.when((n > 5) & (repeat > 3) & (repeat / n > 0.15), 5).otherwise(0)
    if style != "minimal":
        for some in ELEMENTS:
            loss = loss + F.when(x[some], 0).otherwise(3)
    score = F.greatest(F.lit(0), 100 - loss)
    grade = F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 50, "C").when(score >= 30, "D").otherwise("F")
    return F.struct(score.alias("score"), grade.alias("grade"), n.alias("words"), unique.alias("unique_words"))


def tokens_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def export_caption(text: Column, trigger: str, style: str) -> Column:
    """The caption as exported: as it is, or after the trigger; without commas and spaces at the ends."""
    return text if style == "active" else F.btrim(F.concat(F.lit(trigger + ", "), text), F.lit(", "))

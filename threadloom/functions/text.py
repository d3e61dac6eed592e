"""Text expressions: mentions, JSON leaves, normalised tokens."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Indonesian stop words, slang forms and their meanings, and tokens that are never changed.
INDONESIAN_STOP_WORDS = (
    "ada adalah agar akan aku anda apa apakah atas atau awal bagai bagaimana bagi bahwa banyak baru begini begitu belum benar berada berikut "
    "bersama bisa buat cara cukup dalam dan dapat dari daripada dekat demi dengan depan dia di diri dong guna hal hampir hanya harus hingga ia "
    "ini itu jadi jika juga justru kala kalian kami kamu kan karena kata ke kembali kemudian kepada ketika khusus kita kok lagi lah lalu lewat "
    "luar maka makin mana masih masing mau melalui memang mereka meski mungkin namun nih nya oleh pada paling para per pernah pula pun saat saja "
    "saling sama sambil sampai sana sangat satu saya sebab sebagai sebelum sebuah sedang sejak sekali sekitar selain selalu seluruh semua "
    "sementara sempat sendiri serta setelah setiap siapa sih tanpa tapi telah tentang tentu terus tetap tiap toh untuk usah via yaitu yakni yang"
).split()
SLANG = {
    "aq": "aku", "ak": "aku", "gw": "aku", "gue": "aku", "gua": "aku", "loe": "kamu", "lu": "kamu", "km": "kamu", "gk": "tidak", "ga": "tidak",
    "gak": "tidak", "ngga": "tidak", "nggak": "tidak", "tdk": "tidak", "yg": "yang", "dgn": "dengan", "dr": "dari", "utk": "untuk",
    "bgt": "banget", "banget": "sangat",
}
PRESERVED = ("url_token", "emoji_token", "mention_token")
# Code point ranges of emoji, and affixes in the order they are tried.
EMOJI = (
    r"[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}"
    r"\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}]+"
)
PARTICLES = "lah|kah|pun|nya|ku|mu"
PREFIXES = "meng|meny|men|mem|ber|ter|peng|peny|pen|pem|per|di|ke|se|me|pe"
SUFFIXES = "kan|an|i"
#: The rules in order; a "!" marks a token as done. (pattern, replacement) hold for Java and RE2 alike.
STEPS = (
    (rf"^([^!]{{4,}})(?:{PARTICLES})$", 1, ""),
    (r"^([^!]{3,})ies$", 1, "y!"),
    (r"^([^!]{4,})(?:ing|ed)$", 1, "!"),
    (r"^([^!]{3,}[^s!])s$", 1, ""),
    (rf"^(?:{PREFIXES})([^!]{{4,}})$", 1, ""),
    (rf"^([^!]{{4,}}?)(?:{SUFFIXES})$", 1, ""),
    (r"^(.*)!$", 1, ""),
)
MENTION = r"@([A-Za-z0-9_\.]+)"


@lru_cache(1)
def stop_words(english: str | None = None) -> list[str]:
    """The Indonesian list and an English one, by default the widely used list of 318 words in ``stopwords_en.txt``."""
    path = Path(english) if english else Path(__file__).with_name("stopwords_en.txt")
    return sorted({*INDONESIAN_STOP_WORDS, *path.read_text().split()})


def mentions(text: Column) -> Column:
    """Lower-cased names after an at sign, trailing dots kept; an empty array for null."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MENTION), F.lit(1)), F.lower)


def json_leaves(json: Column) -> Column:
    """Non-empty scalar values in JSON text, in order and as strings, keys left out; an empty array for null."""
    tokens = F.regexp_extract_all(json, F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?|-?[0-9][0-9.eE+-]*|true|false'), F.lit(0))
    values = F.filter(tokens, lambda t: ~t.endswith(":") & (t != '""'))
    # as the values' own text: booleans are True and False there
    texts = F.from_json(F.concat(F.lit("["), F.array_join(F.transform(values, lambda t: F.when(t == "true", '"True"').when(t == "false", '"False"').otherwise(t)), ","), F.lit("]")), "array<string>")
    return F.coalesce(texts, F.array().cast("array<string>"))


@F.pandas_udf(StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c)))


def strip_accents(text: Column) -> Column:
    """Lower case without combining marks. ASCII text, which has none, stays in the JVM."""
    other = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.coalesce(_folded(other), F.lower(text))


def lemma(token: Column) -> Column:
    """Slang replaced once, then one particle, plural or participle ending, one prefix and one suffix taken off."""
    slang = F.create_map(*[F.lit(x) for kv in SLANG.items() for x in kv])
    out = F.coalesce(F.element_at(slang, token), token)
    out = F.when(out.isin(*PRESERVED), F.concat(out, F.lit("!"))).otherwise(out)
    for pattern, _, tail in STEPS:
        out = F.regexp_replace(out, pattern, f"$1{tail}")
    return out


def tokens(text: Column) -> Column:
    """Raw tokens of a text: links, mentions and emoji runs become one token each, hashtags their word."""
    t = strip_accents(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, r"(?U)(?i)https?://\S+|www\.\S+", " url_token ")
    t = F.regexp_replace(t, r"(?U)(?<!\w)@[\w.]+", " mention_token ")
    t = F.regexp_replace(t, r"(?U)(?<!\w)#(\w+)", " $1 ")
    t = F.regexp_replace(t, EMOJI, " emoji_token ")
    return F.regexp_extract_all(t, F.lit("[a-z0-9_]+"), F.lit(0))


def normalized_tokens(text: Column, english: str | None = None) -> Column:
    """Lemmas of at least two characters that are no stop words; stop words are tested after stemming."""
    stops = stop_words(english)  # a literal list becomes a hash set
    return F.filter(F.transform(tokens(text), lemma), lambda t: t.isin(*PRESERVED) | ((F.length(t) >= 2) & ~t.isin(*stops)))


def normalized(text: Column) -> Column:
    return F.array_join(normalized_tokens(text), " ")

"""Text diagnostics as column expressions; only lossless chunking and loops over long texts leave the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from ledgerloom.sources.batches import bounded_batches

#: Scripts by name, as regular-expression classes.
SCRIPTS = {"kana": r"[\p{IsHiragana}\p{IsKatakana}]", "han": r"\p{IsHan}", "arabic": r"\p{IsArabic}", "cyrillic": r"\p{IsCyrillic}", "devanagari": r"\p{IsDevanagari}", "latin": r"\p{IsLatin}"}
#: Language that a script stands for, in the order in which they are tried: kana before Han.
SCRIPT_LANGUAGE = [("kana", "ja"), ("han", "zh"), ("arabic", "ar"), ("cyrillic", "ru"), ("devanagari", "hi")]


def script_language(text: Column, first: int = 100) -> Column:
    """Language by the scripts in the first characters; en where none is found."""
    head = F.substring(text, 1, first)
    out = F.when(head.rlike(SCRIPTS["kana"]), "ja")
    for script, lang in SCRIPT_LANGUAGE[1:]:
        out = out.when(head.rlike(SCRIPTS[script]), lang)
    return out.otherwise("en")


def script_share(text: Column, script: str) -> Column:
    """Share of the letters; null where there are none."""
    return F.try_divide(F.regexp_count(text, F.lit(SCRIPTS[script])), F.regexp_count(text, F.lit(r"\p{L}")))


def script_mismatch(text: Column, script: str, share: float = 0.2, least: int = 20) -> Column:
    return (F.length(text) >= least) & F.coalesce(script_share(text, script) < share, F.lit(True))


def replacement_rate(text: Column) -> Column:
    return F.try_divide(F.regexp_count(text, F.lit("�")), F.length(text))


def control_rate(text: Column) -> Column:
    return F.try_divide(F.regexp_count(text, F.lit(r"[\p{Cc}\p{Cf}&&[^\n\r\t]]")), F.length(text))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))


def unique_word_ratio(text: Column) -> Column:
    w = words(text)
    return F.try_divide(F.size(F.array_distinct(w)), F.size(w))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens as texts, from n shifted copies: linear in the tokens."""
    shifted = [F.slice(tokens, i + 1, F.greatest(F.size(tokens) - n + 1, F.lit(0))) for i in range(n)]
    return F.transform(F.arrays_zip(*[s.alias(f"t{i}") for i, s in enumerate(shifted)]), lambda x: F.concat_ws(" ", *[x[f"t{i}"] for i in range(n)]))


def repeated_ngram_ratio(text: Column, n: int = 3) -> Column:
    """Share of the n-grams that stood before. Words and n-grams are bound to names, so each is made once."""
    share = lambda g: F.when(F.size(g) > 0, 1 - F.size(F.array_distinct(g)) / F.size(g)).otherwise(0.0)
    return F.transform(F.transform(F.array(words(text)), lambda w: ngrams(w, n)), share)[0]


@pandas_udf(BooleanType())
def repetition_loop(texts: pd.Series) -> pd.Series:
    """Whether any run of four words stands four times or more: one count over the words, no backtracking."""
    import re
    from collections import Counter

    def loops(text: str | None) -> bool:
        w = re.findall(r"\w+", (text or "").lower())
        return max(Counter(zip(w, w[1:], w[2:], w[3:], strict=False)).values(), default=0) >= 4

    return texts.map(loops)


def echo_overlap(prompt: Column, response: Column) -> Column:
    """Share of the prompt's distinct words that the response repeats."""
    p = F.array_distinct(words(prompt))
    return F.try_divide(F.size(F.array_intersect(p, words(response))), F.size(p))


def punctuation_rate(text: Column) -> Column:
    return F.try_divide(F.regexp_count(text, F.lit(r"\p{P}")), F.length(text))


def truncation_suspect(text: Column, longest: int = 3500) -> Column:
    """Long and without an end mark."""
    return (F.length(text) > longest) & ~F.rtrim(text).rlike(r"""[.!?…。！？।؟"'”’)\]]$""")


def slug(text: Column, longest: int = 48) -> Column:
    """ASCII slug; a text that leaves none gets a short SHA-1."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    s = F.regexp_replace(F.substring(s, 1, longest), "_+$", "")
    return F.when(s == "", F.concat(F.lit("id_"), F.substring(F.sha1(text), 1, 10))).otherwise(s)


def collapse(text: Column, boilerplate: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, boilerplate, ""), r"\s+", " "))


def after_delimiter(text: Column) -> Column:
    """What follows the first colon, of any of the four forms."""
    return F.trim(F.regexp_extract(text, "(?s)^[^:：︰﹕]*[:：︰﹕](.*)$", 1))


def foreign(text: Column, share: float = 0.25) -> Column:
    other, latin = F.regexp_count(text, F.lit(r"[\p{L}&&[^\p{IsLatin}]]")), F.regexp_count(text, F.lit(r"\p{IsLatin}"))
    return other > share * latin


def lenient_json(text: Column, schema: str) -> Column:
    """The first {...} of a reply, fences stripped, parsed; null where it isn't JSON."""
    return F.from_json(F.regexp_extract(F.regexp_replace(text, "```(?:json)?", ""), r"(?s)(\{.*\})", 1), schema, {"mode": "PERMISSIVE"})


def prettified(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def chat(system: Column, user: Column) -> Column:
    return F.format_string("<|system|>\n%s\n<|user|>\n%s\n<|assistant|>\n", system, user)


def chunks(df: DataFrame, text: str, target: int = 3000) -> DataFrame:
    """df with chunk_no and chunk: pieces of at most ``target`` characters, cut after the last line end or else
    space inside it; joined they are the text again. A null or empty text has no chunk."""
    others = df.columns
    bounded_batches(df.sparkSession)

    def cut(value: str) -> list[str]:
        out, at = [], 0
        while len(value) - at > target:
            end = value.rfind("\n", at, at + target) + 1 or value.rfind(" ", at, at + target) + 1
            end = end if end > at else at + target
            out.append(value[at:end])
            at = end
        return out + [value[at:]] * (at < len(value))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (whole.iloc[at : at + 128] for whole in frames for at in range(0, len(whole), 128)):
            pdf = pdf.assign(chunk=[cut(v) if v else [] for v in pdf[text]])
            pdf["chunk_no"] = pdf["chunk"].map(lambda c: list(range(len(c))))
            yield pdf.explode(["chunk", "chunk_no"]).dropna(subset=["chunk_no"]).astype({"chunk_no": "int32"})[[*others, "chunk_no", "chunk"]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, chunk_no int, chunk string")


def codebook_errors(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks."""
    return F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules.items()]))

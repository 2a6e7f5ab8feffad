"""Column builders for the tokens of a speech recogniser: prompts, texts, times and segments."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessitura.functions.text import trim_space

#: Language codes in the order of their tokens.
LANGUAGES = (
    "en zh de es ru ko fr ja pt tr pl ca nl ar sv it id hi fi vi he uk el ms cs ro da hu ta no th ur hr bg lt la mi ml cy sk "
    "te fa lv bn sr az sl kn et mk br eu is hy ne mn bs kk sq sw gl mr pa si km sn yo so af oc ka be tg sd gu am yi lo uz fo "
    "ht ps tk nn mt sa lb my bo tl mg as tt haw ln ha ba jw su yue"
).split()
STEP, LAST_STEP = 0.02, 1500


@dataclass(frozen=True)
class SpecialTokens:
    """Ids of a recogniser's special tokens.

    With the defaults the last language has the id of ``transcribe``: the task tokens
    stand 99 places after the first language, and there are 100 languages.
    """

    end: int = 50257
    start: int = 50258
    first_language: int = 50259
    transcribe: int = 50358
    translate: int = 50359
    no_speech: int = 50360
    no_timestamps: int = 50361
    timestamps: int = 50362

    @classmethod
    def english(cls) -> SpecialTokens:
        """Of a vocabulary without languages."""
        return cls(50256, 50257, -1, 50258, 50259, 50260, 50261, 50262)

    @classmethod
    def published(cls) -> SpecialTokens:
        """In the order of the published multilingual vocabulary: translate first, and two more tokens."""
        return cls(transcribe=50359, translate=50358, no_speech=50362, no_timestamps=50363, timestamps=50364)

    def languages(self) -> dict[str, int]:
        return {code: self.first_language + i for i, code in enumerate(LANGUAGES)} if self.first_language >= 0 else {}


DEFAULT = SpecialTokens()


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def language_id(language: Column | str, special: SpecialTokens = DEFAULT) -> Column:
    """The token of a language code; null if there is none."""
    known = special.languages()
    # one search of a constant array for each row
    place = F.array_position(F.split(F.lit(",".join(known)), ","), _c(language)) if known else None
    return F.when(place > 0, (place - 1 + special.first_language).cast("int")) if known else F.lit(None).cast("int")


def whisper_prompt(language: Column | str, translate: bool = False, special: SpecialTokens = DEFAULT) -> Column:
    """[start, language, task]; an unknown language is left out."""
    return F.array_compact(F.array(F.lit(special.start), language_id(language, special), F.lit(special.translate if translate else special.transcribe)))


def until_end(ids: Column | str, special: SpecialTokens = DEFAULT) -> Column:
    a = _c(ids)
    at = F.array_position(a, special.end)
    return F.when(at > 0, F.slice(a, 1, (at - 1).cast("int"))).otherwise(a)


def is_timestamp(token: Column, special: SpecialTokens = DEFAULT) -> Column:
    return token.between(special.timestamps, special.timestamps + LAST_STEP)


def token_to_seconds(token: Column, special: SpecialTokens = DEFAULT) -> Column:
    return F.when(is_timestamp(token, special), (token - special.timestamps) * STEP)


def seconds_to_token(seconds: Column, special: SpecialTokens = DEFAULT) -> Column:
    """The nearest time token; halves go to the even one."""
    return (F.least(F.greatest(F.bround(seconds / STEP, 0), F.lit(0.0)), F.lit(float(LAST_STEP))) + special.timestamps).cast("int")


_MARK, _NONE = "\u0001", "\u0002"


def _lookup(vocab: Mapping[int, str] | Column) -> Callable[[Column], Column]:
    """The token of an id, null if there is none.

    A mapping becomes one constant array, made from one literal and read by place: a map
    would be searched from its start for every id.
    """
    if isinstance(vocab, Column):
        return lambda i: F.try_element_at(vocab, i)
    joined = _MARK.join(vocab.get(i, _NONE) for i in range(max(vocab, default=-1) + 1))
    tokens = F.split(F.lit(joined), _MARK)
    return lambda i: F.nullif(F.get(tokens, i), F.lit(_NONE)) if vocab else F.lit(None).cast("string")


def whisper_decode(ids: Column | str, vocab: Mapping[int, str] | Column, special: SpecialTokens = DEFAULT) -> Column:
    """The text of ids up to the end, without special and unknown ones."""
    own = _lookup(vocab)
    words = F.transform(F.filter(until_end(ids, special), lambda i: i < special.start), own)
    return F.array_join(F.array_compact(words), "")


def whisper_decode_timestamps(ids: Column | str, vocab: Mapping[int, str] | Column, special: SpecialTokens = DEFAULT) -> Column:
    """Like whisper_decode, with times as [1.00s]."""
    own = _lookup(vocab)
    stamp = lambda i: F.concat(F.lit("["), F.format_string("%.2f", (i - special.timestamps) * STEP), F.lit("s]"))
    words = F.transform(until_end(ids, special), lambda i: F.when(is_timestamp(i, special), stamp(i)).when(i < special.start, own(i)))
    return F.array_join(F.array_compact(words), "")


def whisper_segments(ids: Column | str, vocab: Mapping[int, str] | Column, special: SpecialTokens = DEFAULT) -> Column:
    """array<struct<text, start, end>>: texts between an odd time token and the next one.

    Text before the first time of a pair goes into its segment; blank segments and text
    after the last pair are left out.  The places of the times are found first, so that each
    token is read twice, however many segments there are.
    """
    own = _lookup(vocab)
    a = until_end(ids, special)
    timed = F.transform(a, lambda i, at: F.struct(at.alias("at"), token_to_seconds(i, special).alias("t")))
    both = F.struct(a.alias("a"), F.filter(timed, lambda x: x["t"].isNotNull()).alias("s"))

    def cut(b: Column) -> Column:
        pairs = F.floor(F.size(b["s"]) / 2).cast("int")

        def segment(k: Column) -> Column:
            first, last = F.get(b["s"], 2 * k), F.get(b["s"], 2 * k + 1)
            begin = F.coalesce(F.get(b["s"], F.nullif(2 * k - 1, F.lit(-1)))["at"] + 1, F.lit(0))
            words = F.transform(F.slice(b["a"], begin + 1, last["at"] - begin), lambda i: F.when(i < special.start, own(i)))
            return F.struct(trim_space(F.array_join(F.array_compact(words), "")).alias("text"), first["t"].alias("start"), last["t"].alias("end"))

        found = F.when(pairs > 0, F.transform(F.sequence(F.lit(0), pairs - 1), segment)).otherwise(F.array().cast("array<struct<text:string,start:double,end:double>>"))
        return F.filter(found, lambda s: s["text"] != "")

    return F.get(F.transform(F.array(both), cut), F.lit(0))

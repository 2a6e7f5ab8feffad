"""Column builders for text: sentences, paragraphs, phonemes and character models."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The symbols of the phoneme vocabulary, in the order of their ids from 0 on.
PHONEME_PAD = "$"
PHONEME_PUNCTUATION = ";:,.!?¡¿—…\"«»“” "
PHONEME_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
PHONEME_IPA = (
    "ɑɐɒæɓʙβɔɕçɗɖðʤəɘɚɛɜɝɞɟʄɡɠɢʛɦɧħɥʜɨɪʝɭɬɫɮʟɱɯɰŋɳɲɴøɵɸθœɶʘɹɺɾɻʀʁɽʂʃʈʧʉʊʋⱱʌɣɤʍχʎʏʑʐʒʔʡʕʢǀǁǂǃˈˌːˑʼʴʰʱʲʷˠˤ˞↓↑→↗↘̩ᵻ"
)
PHONEMES = PHONEME_PAD + PHONEME_PUNCTUATION + PHONEME_LETTERS + PHONEME_IPA

#: White space as the Unicode classes of regular expressions have it.
_SPACE = r"[\s\u0085\p{Z}]"
SENTENCE_END = "[.!?]+"
SPM_SPACE = "▁"
SPM_CONTROL = ("<unk>", "<s>", "</s>", "<pad>")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_space(text: Column) -> Column:
    """Without white space of any kind at either end (``trim`` knows U+0020 only)."""
    return F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+\z", "")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def sentence_split(text: Column | str) -> Column:
    """The trimmed pieces between runs of . ! and ?, without empty ones."""
    return F.filter(F.transform(F.split(_c(text), SENTENCE_END), trim_space), lambda s: s != "")


def ensure_punctuation(text: Column) -> Column:
    """Ends with a comma unless it ends with one of . ! ? , ; : or is empty."""
    return F.when((text == "") | text.rlike(r"[.!?,;:]\z"), text).otherwise(F.concat(text, F.lit(",")))


def pack_words(sentence: Column, most: int, measure: Callable[[Column], Column] = utf16_length) -> Column:
    """Words of a sentence in chunks of at most ``most`` with their punctuation; a longer word is a chunk of its own."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(s: Column, word: Column) -> Column:
        longer = F.when(s["now"] == "", word).otherwise(F.concat(s["now"], F.lit(" "), word))
        fits = measure(ensure_punctuation(longer)) <= most
        cut = F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"])))
        return F.struct(F.when(fits, s["done"]).otherwise(cut).alias("done"), F.when(fits, longer).otherwise(word).alias("now"))

    words = F.filter(F.split(sentence, " "), lambda w: w != "")
    done = F.aggregate(words, start, step, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))
    return F.transform(done, ensure_punctuation)


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x made once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def sentence_chunks(text: Column | str, most: int | None = None, measure: Callable[[Column], Column] = utf16_length) -> Column:
    """Sentences with closing punctuation, the long ones packed by words; a text without any is one chunk."""
    t = _c(text)
    if most is None:
        chunks = F.transform(sentence_split(t), ensure_punctuation)
    else:
        fits = lambda s: measure(ensure_punctuation(s)) <= most
        chunks = F.flatten(F.transform(sentence_split(t), lambda s: F.when(fits(s), F.array(ensure_punctuation(s))).otherwise(pack_words(s, most, measure))))
    return _once(chunks, lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(ensure_punctuation(t))))


_STRIP = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _units(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def packed_sentences(text: str, most: int, measure: Callable[[str], int] = _units) -> list[str]:
    """What sentence_chunks gives for one text; measure sees a chunk with its punctuation."""
    end = lambda s: s if not s or s[-1] in ".!?,;:" else s + ","
    out = []
    for sentence in (s.strip(_STRIP) for s in re.split(SENTENCE_END, text)):
        if not sentence:
            continue
        if measure(end(sentence)) <= most:
            out.append(end(sentence))
            continue
        now: list[str] = []
        size = -1
        for word in filter(None, sentence.split(" ")):
            if measure is _units:  # lengths add up, so that a chunk isn't measured again for each word
                more = size + 1 + _units(word)
                fits = more + (word[-1] not in ".!?,;:") <= most
            else:
                more, fits = 0, measure(end(" ".join([*now, word]))) <= most
            if not fits:
                if now:
                    out.append(end(" ".join(now)))
                now, more = [], _units(word)
            now.append(word)
            size = more
        if now:
            out.append(end(" ".join(now)))
    return out or [end(text)]


def sentence_chunks_arrow(text: Column | str, most: int, measure: Callable[[str], int] = _units) -> Column:
    """sentence_chunks on Arrow batches, for long texts and measures in Python: its time grows with the text."""

    @F.pandas_udf("array<string>")
    def chunk(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else packed_sentences(t, most, measure))

    return chunk(_c(text))


def paragraphs(text: Column | str) -> Column:
    """Trimmed paragraphs between blank lines, without empty ones; the whole trimmed text where none is left."""
    t = F.regexp_replace(_c(text), "\r\n?", "\n")
    found = F.filter(F.transform(F.split(t, "\n\n"), trim_space), lambda s: s != "")
    return _once(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(trim_space(t))))


def extract_text(parts: Column | str) -> Column:
    """The trimmed parts of a document that aren't blank, joined by a space."""
    return F.array_join(F.filter(F.transform(F.filter(_c(parts), lambda p: p.isNotNull()), trim_space), lambda s: s != ""), " ")


# phonemes


def phoneme_normalize(text: Column | str) -> Column:
    """Words and single other signs, joined by spaces."""
    return F.array_join(F.regexp_extract_all(_c(text), F.lit(r"(?U)(\w+|[^\w\s])"), 1), " ")


_BASIC = 1 << 16


def by_character(ids: Mapping[str, int]) -> Callable[[Column], Column]:
    """The id of a character, null if there is none.

    One constant array, read by code point: a map would be searched from its start for every
    character.  Characters beyond the basic plane, of which a vocabulary has few, are in a map.
    """
    single = {ord(s): i for s, i in ids.items() if len(s) == 1}
    basic = {c: i for c, i in single.items() if c < _BASIC}
    rest = {chr(c): i for c, i in single.items() if c >= _BASIC}
    places = F.split(F.lit(",".join(str(basic.get(c, "")) for c in range(max(basic, default=-1) + 1))), ",")
    other = F.create_map(*(F.lit(x) for kv in rest.items() for x in kv)) if rest else None

    def find(c: Column) -> Column:
        own = F.nullif(F.get(places, F.ascii(c)), F.lit("")).cast("int") if basic else F.lit(None).cast("int")
        return own if other is None else F.coalesce(own, F.try_element_at(other, c))

    return find


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def phoneme_encode(text: Column | str, most: int | None = None) -> Column:
    """Ids of the known symbols of a normalised text."""
    known = F.array_compact(F.transform(characters(phoneme_normalize(text)), by_character({s: i for i, s in enumerate(PHONEMES)})))
    return F.slice(known, 1, most) if most is not None else known


def phoneme_decode(ids: Column | str) -> Column:
    """Symbols of ids, without padding and unknown ids."""
    symbols = F.array(*(F.lit(s) for s in PHONEMES))
    return F.array_join(F.transform(F.filter(_c(ids), lambda i: (i > 0) & (i < len(PHONEMES))), lambda i: F.get(symbols, i)), "")


def count_phonemes(text: Column | str) -> Column:
    return F.size(phoneme_encode(text))


# character models


def spm_normalize(text: Column | str) -> Column:
    return F.concat(F.lit(SPM_SPACE), F.translate(_c(text), " ", SPM_SPACE))


def spm_char_encode(text: Column | str, vocab: Mapping[str, int] | Column, unknown: int = 0, most: int | None = None) -> Column:
    """One id for each character, the unknown one where the vocabulary has none."""
    own = (lambda c: F.try_element_at(vocab, c)) if isinstance(vocab, Column) else by_character(vocab)
    ids = F.transform(characters(spm_normalize(text)), lambda c: F.coalesce(own(c), F.lit(unknown)))
    return F.slice(ids, 1, most) if most is not None else ids


def spm_char_decode(ids: Column | str, pieces: Mapping[int, str] | Column) -> Column:
    """The text of ids, without control pieces and unknown ids."""
    if isinstance(pieces, Column):
        own = lambda i: F.try_element_at(pieces, i)
    else:  # by place
        listed = F.split(F.lit("\u0001".join(pieces.get(i, "\u0002") for i in range(max(pieces, default=-1) + 1))), "\u0001")
        own = lambda i: F.nullif(F.get(listed, i), F.lit("\u0002"))
    text = F.array_compact(F.transform(_c(ids), own))
    return F.regexp_replace(F.translate(F.array_join(F.filter(text, lambda p: ~p.isin(*SPM_CONTROL)), ""), SPM_SPACE, " "), "^ ", "")


# transcripts

#: Marks that recognisers leave in their text.
MARKS = ("<|endoftext|>", "<|startoftranscript|>", "<|transcribe|>", "<|translate|>", "<|nospeech|>", "<|notimestamps|>")


def clean_transcription(text: Column | str, passes: int = 2) -> Column:
    """Without marks <|...|> and white space at the ends; null gives an empty text.

    Removing a mark may make another one of what stood around it, so this is done
    ``passes`` times.
    """
    out = F.coalesce(_c(text), F.lit(""))
    for mark in MARKS:
        out = F.replace(out, F.lit(mark), F.lit(""))
    for _ in range(passes):
        out = F.regexp_replace(out, r"(?s)<(?=\|).*?\|>", "")
    return trim_space(out)

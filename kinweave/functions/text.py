"""What people wrote: cleaning of messages, words, stop words, names. Column expressions, evaluated without leaving the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: words that a mail program puts before what it quotes, and its headers, in seven languages ----
WROTE = ["wrote", "écrit", "schrieb", "escribió", "scritto", "schreef", "escreveu"]
OPENERS = ["on", "le", "am", "el", "il", "op", "em"]
SENDERS = ["from", "de", "von"]
HEADERS = ["sent", "date", "to", "subject", "cc", "envoyé", "gesendet", "enviado"]
ORIGINALS = ["original message", "forwarded message", "message d'origine", "ursprüngliche nachricht", "mensaje original"]
# ---- fixed values: words of dates and mail, and labels of mail domains ----
CALENDAR = (
    "mon tue tues wed thu thur thurs fri sat sun monday tuesday wednesday thursday friday saturday sunday jan feb mar apr jun jul aug sep sept oct nov dec "
    "january february march april june july august september october november december am pm utc gmt wrote fwd fw re cc bcc"
).split()
DOMAINS = "com org net edu gov io co uk us de fr example mail gmail googlemail outlook hotmail yahoo icloud me live msn aol proton protonmail www".split()
# ---- fixed values: English function words; contractions follow from the rule below. Other lists are a parameter ----
ENGLISH = (
    "a about above after again against all almost also am among an and any are as at be because been before being below between both but by can cannot could did do does doing down during "
    "each either else ever every few for from further get gets got had has have having he her here hers herself him himself his how however i if in into is it its itself just let like may me might more most "
    "must my myself neither no nor not now of off often on once one only or other ought our ours ourselves out over own per quite rather really same say says shall she should since so some still such than that "
    "the their theirs them themselves then there these they this those though through thus to too under until up upon us very was we were what when where whether which while who whom whose why will with within "
    "without would yet you your yours yourself yourselves"
).split()


def english_stopwords() -> list[str]:
    """The function words and their contractions: be, have, will and would after pronouns, not after auxiliaries; also as written without the mark."""
    who = {"i": ["'m"], "he": ["'s"], "she": ["'s"], "it": ["'s"], "we": ["'re"], "you": ["'re"], "they": ["'re"]}
    out = set(ENGLISH)
    for word, own in who.items():
        out |= {word + end for end in [*own, "'d", "'ll", *([] if word in ("he", "she", "it") else ["'ve"])]} - {"it'd", "it'll"}
    out |= {f"{w}'s" for w in "here how let that there what when where who why".split()}
    out |= {f"{w}n't" for w in "are could did does do had has have is must should was were would".split()} | {"can't", "shan't", "won't"}
    out |= {w.replace("'", "") for w in ("i'm", "i've", "i'd", "don't", "doesn't", "didn't", "can't", "won't", "isn't", "aren't", "wasn't", "weren't", "you're", "they're", "that's", "what's", "let's")}
    return sorted(out)


def _any(words: list[str]) -> str:
    return "|".join(w.replace("'", "['’]") for w in words)


#: Marks of a line; (?i) and Unicode classes as in (?iu).
_QUOTED = r"^>"
_WROTE = rf"(?iu)(?:^|[^\p{{L}}])(?:{_any(WROTE)})\s*:\s*$"
_OPENS = rf"(?iu)^(?:{_any(OPENERS)})(?![\p{{L}}\p{{N}}_])"
_ORIGINAL = rf"(?iu)^(?:-{{2,}}\s*(?:{_any(ORIGINALS)})\s*-{{2,}}$|begin forwarded message|-{{5,}}\s*forwarded)"
_SENDER = rf"(?iu)^(?:{_any(SENDERS)})\s*:\s*\S"
_SENDER_LINE = rf"(?iu)^(?:{_any(SENDERS)})\s*:"
_HEADER = rf"(?iu)^(?:{_any(HEADERS)})\s*:"
_DEVICE = r"(?i)^(?:sent from my \S+|get outlook for )"


def _sql(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'" if "'" not in pattern else "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def cleaned(text: str) -> Column:
    """struct(text, quoted, signature): what the sender wrote, without quoted lines, forwarded mail or a signature; null stays null.

    Each line is marked k(ept), q(uoted line), d(evice line), Q (the quoted rest begins) or S (the signature begins); what is kept is the kept lines before the first Q or S."""
    t = lambda i: f"trim(coalesce(try_element_at(lines, {i}), ''))"
    here = "trim(x)"
    later = f"exists(slice(lines, i + 2, 3), y -> trim(y) RLIKE {_sql(_HEADER)})"
    mark = f"""CASE WHEN {here} RLIKE {_sql(_QUOTED)} THEN 'q'
        WHEN {here} RLIKE {_sql(_WROTE)} AND {here} RLIKE {_sql(_OPENS)} THEN 'Q'
        WHEN {here} RLIKE {_sql(_OPENS)} AND {t('i + 2')} RLIKE {_sql(_WROTE)} AND NOT {here} LIKE '%.' THEN 'Q'
        WHEN {here} RLIKE {_sql(_ORIGINAL)} THEN 'Q'
        WHEN {here} RLIKE '^_{{8,}}$' AND {t('i + 2')} RLIKE {_sql(_SENDER_LINE)} THEN 'Q'
        WHEN {here} RLIKE {_sql(_SENDER)} AND {later} THEN 'Q'
        WHEN x = '-- ' OR {here} = '--' THEN 'S'
        WHEN {here} RLIKE {_sql(_DEVICE)} THEN 'd' ELSE 'k' END"""
    lines = f"split({text}, r'\\r?\\n')"
    marks = f"transform(lines, (x, i) -> {mark})"
    stop = "array_position(transform(marks, m -> m IN ('Q', 'S')), true)"
    upto = f"if({stop} = 0, size(marks), cast({stop} - 1 AS int))"
    kept = f"array_join(transform(filter(arrays_zip(slice(lines, 1, {upto}), slice(marks, 1, {upto})), z -> z['1'] = 'k'), z -> z['0']), '\\n')"
    seen = f"slice(marks, 1, if({stop} = 0, size(marks), cast({stop} AS int)))"
    whole = f"named_struct('text', {kept}, 'quoted', exists({seen}, m -> m IN ('q', 'Q')), 'signature', exists({seen}, m -> m IN ('d', 'S')))"
    steps = f"transform(array({lines}), lines -> transform(array({marks}), marks -> {whole})[0])[0]"
    plain = f"named_struct('text', {text}, 'quoted', false, 'signature', false)"
    return F.expr(f"if({text} IS NULL, NULL, if(instr({text}, '\\n') = 0 AND NOT startswith({text}, '>'), {plain}, {steps}))")


def nfkc(text: Column) -> Column:
    """Compatibility forms of letters to plain ones; only for texts that may hold some, as it leaves the JVM."""

    def plain(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t) if isinstance(t, str) else t)

    return F.pandas_udf(plain, "string")(text)


_ANGLES, _URL, _EMAIL = r"<[@#!][^>]*>|<https?:[^>]*>", r"(?iu)(?<![\p{L}\p{N}_])(?:https?://|www\.)\S+", r"(?u)(?<![\p{L}\p{N}_])[\w.+-]+@[\w-]+\.[\w.-]+"
_MENTION, _CODE, _EMOJI = r"(?u)(^|[^\w])@[\p{L}\p{N}_.-]+", r":[a-z0-9_+-]{2,40}:", r"[\x{200D}\x{FE0F}]"
_WORD = r"[\p{L}\p{M}][\p{L}\p{M}\p{N}'’_-]*"


def tokens(text: str | Column, stop: list[str] | None = None, least: int = 2) -> Column:
    """The words of a text, lower-case, without links, addresses, mentions, emoji codes and possessive 's; words of ``least`` characters, none of the stop words
    (also as written without apostrophes)."""
    s = F.col(text) if isinstance(text, str) else text
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, _ANGLES, " "), _URL, " "), _EMAIL, " ")
    s = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, _MENTION, "$1 "), _CODE, " "), _EMOJI, " "))
    words = F.transform(F.regexp_extract_all(s, F.lit(_WORD), F.lit(0)), lambda w: F.regexp_replace(F.regexp_replace(F.regexp_replace(w, "’", "'"), r"^['_-]+|['_-]+$", ""), "'s$", ""))
    words = F.filter(words, lambda w: F.length(w) >= least)
    if stop:
        listed = F.array(*[F.lit(w) for w in sorted(set(stop))])
        words = F.filter(words, lambda w: ~(F.array_contains(listed, w) | F.array_contains(listed, F.regexp_replace(w, "'", ""))))
    return words


def name_words(nodes: DataFrame) -> DataFrame:
    """(word) that names the people in the data: parts of labels, and local parts and domains of addresses in keys and ``email`` attributes; bots don't count."""
    people = nodes.where("NOT coalesce(is_bot, false)")
    address = lambda c: F.regexp_extract(c, r"([\w.+-]+@[\w.-]+)", 1)
    parts = people.select(F.explode(F.array(F.coalesce("label", F.lit("")), F.coalesce(address(F.col("key")), F.lit("")), F.coalesce(address(F.expr("attrs['email']")), F.lit("")))).alias("part"))
    words = parts.select(F.explode(F.regexp_extract_all(F.lower("part"), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))).alias("word"))
    return words.where((F.length("word") >= 2) & ~F.col("word").isin(*DOMAINS)).distinct()


def is_common(word: Column, common: list[str]) -> Column:
    """Whether a word is one of the common ones, also after a regular ending is undone: -s -es -ed -d -ing -er -est -ly, doubled last letters, -i for -y, lost -e."""
    listed = F.array(*[F.lit(w) for w in sorted(set(common))])
    forms = [word]
    for end in ("s", "es", "ed", "d", "ing", "er", "est", "ly"):
        stem = F.when(word.endswith(end) & (F.length(word) > len(end) + 1), F.regexp_replace(word, f"{end}$", ""))
        forms += [stem, F.concat(stem, F.lit("e")), F.when(stem.rlike(r"([b-df-hj-np-tv-z])\1$"), F.regexp_replace(stem, ".$", "")), F.when(stem.endswith("i"), F.concat(F.regexp_replace(stem, "i$", ""), F.lit("y")))]
    return F.exists(F.array_compact(F.array(*forms)), lambda w: F.array_contains(listed, w))


def clipped(text: Column, most: int = 280) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def unaccented(text: Column) -> Column:
    """Lower-case, Latin letters without accents, runs of space as one."""
    plain = F.translate(F.lower(text), "àáâãäåāăąçćčďđèéêëēėęěìíîïīįłñńňòóôõöøōőŕřśšşťţùúûüūůűųýÿźżž", "aaaaaaaaacccddeeeeeeeeiiiiiilnnnoooooooorrsssttuuuuuuuuyyzzz")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\p{M}+", ""), r"\s+", " "))


def name_tokens(name: Column) -> Column:
    """The words of a person's name in order; 'Last, First' is turned."""
    swapped = F.regexp_replace(unaccented(name), r"^([^,]+),\s*([^,]+)$", "$2 $1")
    return F.filter(F.split(F.trim(F.regexp_replace(swapped, r"[^\p{L}\p{N}\s'-]", " ")), r"\s+"), lambda w: w != "")


def phone(number: Column) -> Column:
    """Digits of a phone number, + in front where its country is known; null unless 7 to 15 digits."""
    bare = F.regexp_replace(number, r"\(0\)|[^\d+]", "")
    bare = F.regexp_replace(bare, "^00", "+")
    digits = F.regexp_replace(bare, r"\D", "")
    return F.when(F.length(digits).between(7, 15), F.when(bare.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits))


def entities_decoded(text: Column) -> Column:
    """The common named and all numeric character references of one character replaced."""
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("nbsp", " ")):
        text = F.regexp_replace(text, f"&{name};", sign)
    numeric = F.regexp_extract_all(text, F.lit(r"&#(x?[0-9A-Fa-f]{1,6});"), F.lit(1))
    code = lambda n: F.when(n.startswith("x"), F.conv(F.substring(n, 2, 8), 16, 10)).otherwise(n).cast("int")
    text = F.aggregate(F.array_distinct(numeric), text, lambda t, n: F.replace(t, F.concat(F.lit("&#"), n, F.lit(";")), F.decode(F.unhex(F.lpad(F.hex(code(n)), 8, "0")), "UTF-32")))
    return F.regexp_replace(text, "&amp;", "&")


def html_stripped(html: Column) -> Column:
    """Text of HTML: breaks and block ends as line ends, other tags away, entities decoded."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", "")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])>", "\n"), r"(?s)<[^>]*>", "")
    return F.trim(entities_decoded(text))


def mojibake_fixed(text: Column) -> Column:
    """UTF-8 that was read as Latin-1 read again as UTF-8; text that isn't such stays as it is."""
    latin = text.rlike(r"^[\x00-\xff]*$") & text.rlike(r"[\xc2-\xf4][\x80-\xbf]")
    again = F.try_validate_utf8(F.encode(text, "ISO-8859-1").cast("string"))
    return F.when(latin, F.coalesce(again, text)).otherwise(text)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(unaccented(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")

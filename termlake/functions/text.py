"""Text functions as Column expressions, which stay in the JVM, and word_finder() for tasks in Python."""

from __future__ import annotations

import functools
import html.entities
import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from termlake.tasks import ship

ship(__name__)

# Tags that separate text, function words of English and of French, Dutch, German and Spanish, nouns that name nothing
# in particular, the form of a heading, terms that an interface shows for properties, and what it must never show.
BLOCK_TAGS = """address article aside blockquote br caption col colgroup dd div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table tbody td tfoot th thead tr ul""".split()
ENGLISH_FUNCTION_WORDS = """a an the this that these those my our your its it they them he she we i you is are was were be been being
am do does did done doing have has had having can could shall should will would may might must how what when where why
which who whom whose whether to of in on at by for from with without into onto about over under after before during
between through as and or but not no nor if then than so check checking find finding get getting know knowing see seeing
tell telling use using need needing want wanting make making take taking put putting replace replacing replaced change
changing changed clean cleaning fix fixing often long much many always ever again also just still now soon please help me
mine ok okay""".split()
OTHER_FUNCTION_WORDS = """le la les un une des du de d au aux ce cet cette ces mon ma mes votre vos est sont etait je tu il elle nous
vous ils elles qui que quoi quel quelle quels quelles comment pourquoi quand ou dois faire fait dans sur sous avec sans pour par
entre apres avant plus moins tres
de het een deze dit die dat mijn uw zijn haar ik jij hij zij wij is zijn was waren heb heeft hebben kan kunnen moet moeten zal
zullen hoe wat waar waarom wanneer welke wie doe doen maak maken in op aan van voor met zonder naar bij over onder tussen na
der die das ein eine einen dem den des ich du er sie wir ihr ist sind war waren habe hat haben kann koennen muss muessen wird
werden wie was wo warum wann welche wer mache machen im auf an von fuer mit ohne nach bei ueber unter zwischen
el los las uno una unos unas mi mis su sus este esta estos estas es son era eran tengo tiene tienen puedo pueden debe deben como
que donde por cuando cual quien hago hacer en sobre bajo con sin para entre despues antes""".split()
FUNCTION_WORDS = list(dict.fromkeys(ENGLISH_FUNCTION_WORDS + OTHER_FUNCTION_WORDS))
GENERIC_NOUNS = """process processes procedure procedures method methods thing things stuff item items way ways system systems
information info data detail details step steps question questions""".split()
HEADING = r"^\s{0,3}#{1,6}\s+\S"
SHOWN_AS = {
    "prefLabel": "Preferred term", "altLabel": "Also called", "hiddenLabel": "Common misspelling", "definition": "Definition",
    "scopeNote": "When to use it", "changeNote": "Reason for this change", "broader": "Part of", "narrower": "Includes",
    "related": "See also", "inScheme": "Vocabulary", "notation": "Code", "versionInfo": "Version", "deprecated": "Retired",
    "isReplacedBy": "Replaced by",
}
JARGON = (r"(?i)skos:", r"(?i)owl:", r"(?i)\bdct:", r"(?i)@prefix", r"\bSELECT\b", r"\bprefLabel\b", r"\baltLabel\b", r"\bhiddenLabel\b", r"https?://", r"component\.type", r"fault\.code")
EDGE_MARKS = "[.,;:!?()\\[\\]{}\"'“”‘’]+"


def _folded(character: str) -> str:
    """The compatibility decomposition, without marks and case-folded, anything but a-z and 0-9 being a space."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", character) if not unicodedata.combining(c)).casefold()
    return "".join(c if c.isascii() and c.isalnum() else " " for c in plain)


def _ranges(points: list[int]) -> str:
    """A Java character class of code points in order."""
    parts, first = [], None
    for before, point in zip([None, *points], [*points, None], strict=False):
        if before is None or point != before + 1:
            if first is not None:
                parts.append(rf"\x{{{first:x}}}-\x{{{before:x}}}" if first != before else rf"\x{{{first:x}}}")
            first = point
    return "[" + "".join(parts) + "]"


@functools.cache
def _folds() -> tuple[str, str, str, str, str, str]:
    """Characters of the first plane that fold to one letter or digit, and those; a class of all others that fold to some, and what
    these fold to, as str_to_map reads it; a class of the marks that go; a class that holds these and those and is cheap to look for."""
    before, after, several, marks = [], [], {}, []
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        folded = _folded(chr(cp))
        if not folded:
            marks.append(cp)
            continue
        if len(folded) == 1 and folded != " " and cp < 0x10000:
            before.append(chr(cp))
            after.append(folded)
        elif folded.strip():
            several[cp] = folded
    known = "\x1e".join(f"{chr(cp)}\x1f{folded}" for cp, folded in several.items())
    # one look for whatever is rare, in few ranges: all from the first mark on but punctuation, and what expands before that
    rare = _ranges([cp for cp in range(0x110000) if (cp >= marks[0] and not 0x2000 <= cp < 0x2070 and not 0xD800 <= cp < 0xE000) or (cp in several and cp != 0xDF) or cp in marks])
    return "".join(before), "".join(after), _ranges(sorted(several)), known, _ranges(marks), rare


class Folds(dict):
    """What characters fold to, as str.translate() looks them up; each is folded when it is first met."""

    def __missing__(self, point: int) -> str:
        self[point] = folded = _folded(chr(point))
        return folded


#: Pieces of a text whose words are remembered, and their characters, at most.
REMEMBERED, SHORT = 200_000, 64


def word_finder(wanted: Iterable[str]) -> Callable[[str], set[str]]:
    """What gives a text's words(), each once, as far as they are wanted. For tasks in Python; pieces between white space, all of which
    folds to spaces, are folded once and remembered if they have characters of several bytes, the others all at once."""
    folds, wanted, known = Folds(), frozenset(wanted), {}
    table = "".join(map(_folded, map(chr, range(128))))

    def find(text: str) -> set[str]:
        pieces = () if text.isascii() else [piece for piece in set(text.split()) if not piece.isascii()]
        plain = text if text.isascii() else " ".join([piece for piece in text.split() if piece.isascii()])
        out = set(wanted.intersection(plain.translate(table).split()))
        for piece in pieces:
            words = known.get(piece)
            if words is None:
                words = tuple(wanted.intersection(piece.translate(folds).split()))
                if len(piece) <= SHORT:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = words
            out.update(words)
        return out

    return find


#: What normalise() leaves as it is, possessive so that no text is tried twice.
NORMAL = r"\A[a-z0-9]++(?: [a-z0-9]++)*+\z"


#: What ends a word whatever the words beside it: characters of one byte but letters and digits.
SEPARATORS = r"[\x00-/:-@\[-`{-\x7f]+"


def _single_bytes(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _folded_piece(text: Column) -> Column:
    """normalise() of what has characters of several bytes."""
    before, after, several, known, marks, rare = _folds()
    table = F.str_to_map(F.lit(known), F.lit("\x1e"), F.lit("\x1f"))
    plain = F.replace(text, F.lit("ß"), F.lit("ss"))
    expanded = F.transform(F.regexp_extract_all(plain, F.lit(several), F.lit(0)), lambda c: F.try_element_at(table, c))
    whole = F.array_join(F.zip_with(F.split(plain, several), expanded, lambda piece, c: F.concat(F.coalesce(piece, F.lit("")), F.coalesce(c, F.lit("")))), "")
    out = F.when(plain.rlike(rare), F.regexp_replace(whole, marks, "")).otherwise(plain)
    return F.trim(F.regexp_replace(F.lower(F.translate(out, before, after)), "[^a-z0-9]+", " "))


def normalise(text: Column) -> Column:
    """Without accents and case, runs of anything but a-z and 0-9 as one space, trimmed. Characters that stand for several letters,
    such as ligatures, fractions and Roman numbers, and those beyond the first plane, expand; few texts hold any."""
    # most words are normal already, and most pieces of a text have no character of several bytes, so nothing to look up
    pieces = F.transform(F.split(text, SEPARATORS), lambda w: F.when(_single_bytes(w), F.lower(w)).otherwise(_folded_piece(w)))
    folded = F.array_join(F.filter(pieces, lambda w: w != ""), " ")
    return F.when(text.rlike(NORMAL), text).when(_single_bytes(text), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))).otherwise(folded)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for a row: what a lambda only refers to would be computed at each of its calls."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(vector: Column) -> Column:
    """The vector of length 1 in its direction; zeros stay."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return let(vector, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))))


PLURAL = "([a-z0-9]{2}[a-hj-rtv-z0-9])s$"


def merge_key(text: Column) -> Column:
    """normalise() without a plural s: of a last word of four letters or more that does not end in ss, us or is."""
    return F.regexp_replace(normalise(text), PLURAL, "$1")


def singular(key: Column) -> Column:
    """merge_key() of what is normal already; the column is read several times."""
    return F.when(F.endswith(key, F.lit("s")), F.regexp_replace(key, PLURAL, "$1")).otherwise(key)


def words(text: Column) -> Column:
    """Words of the normalised text; none of a null or empty one."""
    return F.filter(F.split(F.coalesce(normalise(text), F.lit("")), " "), lambda w: w != "")


def question_words(text: Column) -> Column:
    """Words as they stand, marks at their edges removed."""
    bare = F.transform(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, f"^{EDGE_MARKS}|{EDGE_MARKS}$", ""))
    return F.filter(bare, lambda w: w != "")


def ngrams(tokens: Column, most: int = 4) -> Column:
    """(start, size, words) of all runs of up to `most` tokens, start counted from 1."""
    def of(n: Column) -> Column:
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), n.alias("size"), F.array_join(F.slice(tokens, i, n), " ").alias("phrase")))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), of))


def content_phrase(phrase: Column, function_words: list[str] = FUNCTION_WORDS) -> Column:
    """The normalised phrase without function words at either end; inside they stay."""
    known = F.array(*map(F.lit, function_words))
    tokens = words(phrase)
    content = F.filter(F.transform(tokens, lambda w, i: F.when(~F.array_contains(known, w), i + 1)), lambda i: i.isNotNull())
    return F.when(F.size(content) > 0, F.array_join(F.slice(tokens, F.array_min(content), F.array_max(content) - F.array_min(content) + 1), " ")).otherwise("")


def worth_reporting(phrase: Column, top_score: Column | None = None, floor: float = 0.0) -> Column:
    """Something is left of the phrase, and not only generic nouns; with a floor, the best candidate's score reaches it as well."""
    left = F.filter(F.split(content_phrase(phrase), " "), lambda w: w != "")
    named = (F.size(left) > 0) & F.exists(left, lambda w: ~w.isin(GENERIC_NOUNS + FUNCTION_WORDS))
    return named & F.coalesce(top_score >= floor, F.lit(False)) if floor and top_score is not None else named


def names_something(key: Column) -> Column:
    """worth_reporting() of what is normal already: function words at the ends or inside count for nothing either way."""
    return F.exists(F.split(key, " "), lambda w: (w != "") & ~w.isin(GENERIC_NOUNS + FUNCTION_WORDS))


def word_folder() -> Callable[[str], str]:
    """normalise() for tasks in Python, of words that come again and again: they are remembered."""
    folds, known = Folds(), {}

    def fold(word: str) -> str:
        key = known.get(word)
        if key is None:
            key = " ".join(word.translate(folds).split())
            if len(known) >= REMEMBERED:
                known.clear()
            if len(word) <= SHORT:
                known[word] = key
        return key

    return fold


@functools.cache
def _entities() -> tuple[str, str]:
    """A pattern of entities, the longest first, and what names and irregular numbers stand for, as str_to_map reads it."""
    names = html.entities.html5 | {"nbsp;": " "}
    numbers = {f"#{n}": "" for n in html._invalid_codepoints} | {f"#{n}": c for n, c in html._invalid_charrefs.items()}
    pattern = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|" + "|".join(sorted(names, key=len, reverse=True)) + ")"
    return pattern, "\x1e".join(f"{key}\x1f{c}" for key, c in (names | numbers).items())


def unescape(text: Column) -> Column:
    """Named and numeric entities decoded as html.unescape does, but `&nbsp;` as a space."""
    pattern, known = _entities()
    known = F.str_to_map(F.lit(known), F.lit("\x1e"), F.lit("\x1f"))

    def character(entity: Column) -> Column:
        digits = F.regexp_extract(entity, "^&#[xX]?0*([0-9a-fA-F]+)", 1).substr(1, 8)  # eight are too large already
        n = F.when(entity.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("bigint")
        point = F.when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), 0xFFFD).otherwise(n)
        regular = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(point), 8, "0"))), "UTF-32")
        return F.coalesce(F.try_element_at(known, F.substring(entity, 2, 40)), F.try_element_at(known, F.concat(F.lit("#"), n.cast("string"))), regular)

    decoded = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), character)
    return F.array_join(F.zip_with(F.split(text, pattern), decoded, lambda piece, c: F.concat(piece, F.coalesce(c, F.lit("")))), "")


#: Entities that are decoded one after the other where no others are known.
COMMON_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def unescape_common(text: Column) -> Column:
    """COMMON_ENTITIES decoded, written in full and with their semicolon; all others stay as they are."""
    return functools.reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), COMMON_ENTITIES.items(), text)


def flatten_html(markup: Column, decode: Callable[[Column], Column] = unescape) -> Column:
    """Text of markup: comments go, block tags are spaces, other tags nothing, entities decode, runs of spaces are one."""
    out = F.regexp_replace(markup, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, rf"(?i)</?\s*({'|'.join(BLOCK_TAGS)})(?![a-zA-Z0-9])[^>]*>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    out = F.when(F.contains(out, F.lit("&")), decode(out)).otherwise(out)
    return F.trim(F.regexp_replace(out, " {2,}", " "))


def blank_comments(markup: Column) -> Column:
    """Comments become the line breaks inside them, so every later line keeps its number."""
    comment = r"(?s)<!--.*?-->"
    breaks = F.transform(F.regexp_extract_all(markup, F.lit(comment), F.lit(0)), lambda c: F.regexp_replace(c, r"[^\n]+", ""))
    return F.array_join(F.zip_with(F.split(markup, comment), breaks, lambda piece, b: F.concat(piece, F.coalesce(b, F.lit("")))), "")


#: White space as str.split() has it.
BLANK = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANK}]+")), F.lit(0))


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, f"^[{BLANK}]+|[{BLANK}]+$", "")


def token_estimate(text: Column) -> Column:
    """Four thirds of the number of words, rounded down, 1 at least."""
    return F.greatest(F.lit(1), F.floor(word_count(text) * 4 / 3)).cast("int")


def is_heading(line: Column) -> Column:
    return line.rlike(HEADING)


def heading_text(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, "^[# ]+", ""))


def readable(text: Column, is_html: Column) -> Column:
    """Markup flattened, other text as it is."""
    return F.when(is_html, flatten_html(text)).otherwise(text)


def add_gutter(text: Column, first: Column) -> Column:
    """Each line behind its number: L12|text. `first` is the number of the first line."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line, i: F.concat(F.lit("L"), (first + i).cast("string"), F.lit("|"), line)), "\n")


def strip_gutter(text: Column) -> Column:
    """Without such numbers of up to seven characters, L included, before the bar."""
    return F.regexp_replace(text, r"(?m)^L[0-9]{1,6}\|", "")


def whole_word_in(label: Column, corpus: Column) -> Column:
    """A normalised label, as whole words, in a normalised text; an empty label never is."""
    return (label != "") & F.contains(F.concat(F.lit(" "), corpus, F.lit(" ")), F.concat(F.lit(" "), label, F.lit(" ")))


def holds_stem(label: Column, stems: list[str]) -> Column:
    """Any of the stems in the label, whatever its case."""
    return F.lower(label).rlike("|".join(f"\\Q{stem.lower()}\\E" for stem in stems))


def entities(markup: Column) -> Column:
    """The distinct entities of markup, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(markup, F.lit("&[a-zA-Z#][a-zA-Z0-9]*;"), F.lit(0))))


def is_iri(text: Column) -> Column:
    """Holds a colon, and no space, control character or any of <>"{}|^`\\."""
    return F.coalesce(text.contains(":") & ~text.rlike(r'[\x00-\x20<>"{}|^`\\]'), F.lit(False))


def is_language_tag(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*$"), F.lit(False))


def literal(text: Column, language: Column | None = None) -> Column:
    """A literal as an N-Quads line has it. A language that is no tag raises."""
    out = text
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    out = F.concat(F.lit('"'), out, F.lit('"'))
    if language is None:
        return out
    checked = F.when(language.isNull() | is_language_tag(language), language).otherwise(F.raise_error(F.concat(F.lit("not a language tag: "), language)).cast("string"))
    return F.concat(out, F.coalesce(F.concat(F.lit("@"), checked), F.lit("")))


def shown_as(name: Column) -> Column:
    """What an interface calls a property; its own name where there is no other."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in SHOWN_AS.items() for x in pair)), name), name)


def jargon(text: Column) -> Column:
    """Which of the patterns that no reader should meet are in the text, in their order."""
    return F.filter(F.array(*(F.when(text.rlike(pattern), F.lit(pattern)) for pattern in JARGON)), lambda x: x.isNotNull())


def server_event(item: Column) -> Column:
    """A struct as one frame of an event stream."""
    return F.concat(F.lit("data: "), F.to_json(item), F.lit("\n\n"))


def phrase_count(text: Column, phrase: str) -> Column:
    """Mentions of a phrase, whatever the case and the white space between its words."""
    return F.regexp_count(text, F.lit(r"(?i)" + r"\s+".join(f"\\Q{word}\\E" for word in phrase.split())))


def edit_budget(original: Column) -> Column:
    return F.when(F.length(original) <= 4, 1).when(F.length(original) <= 8, 2).otherwise(3)


def is_rewrite(original: Column, corrected: Column) -> Column:
    """Some words are shared, and either their numbers differ or a pair of words is further apart than its budget."""
    a, b = words(original), words(corrected)
    far = F.exists(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: F.levenshtein(p["x"], p["y"]) > edit_budget(p["x"]))
    return F.arrays_overlap(a, b) & ((F.size(a) != F.size(b)) | far)


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def slug(iri: Column) -> Column:
    return F.element_at(F.split(iri, "/"), -1)


def iri_of(namespace: str, name: Column) -> Column:
    return F.concat(F.lit(namespace), name)


def in_namespaces(iri: Column, namespaces: tuple[str, ...]) -> Column:
    """Whether an address is one of ours, so that links to others are left out."""
    return functools.reduce(lambda a, b: a | b, (iri.startswith(n) for n in namespaces))

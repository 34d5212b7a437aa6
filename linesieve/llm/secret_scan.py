"""Secrets in texts: fixed patterns, and strings that a primed compressor finds new.

A candidate is a string of key characters in a sensitive place: on a line with a word such as key
or password, on the lines beside it that hold nothing but such strings, or in a PEM block. Its
novelty is the number of bytes it adds to the compressed text around it, the compressor being
primed with a dictionary of identifiers and usual words; what hardly compresses is reported.
"""

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from functools import cache
from itertools import accumulate
from math import log2

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from linesieve.llm.common import map_texts, sliced

# The patterns of the base kinds, in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ["assign", "access", "hex", "novel"]
MIN_ASSIGN, MIN_ACCESS = 12, 18
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words that make a place sensitive.
SENSITIVE_WORDS = ("key", "secret", "token", "passw", "pwd", "passphrase", "credential", "auth", "bearer", "signature", "private")
SENSITIVE = re.compile("|".join(SENSITIVE_WORDS), re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~-]{12,}")
LEAST = 12
#: Parts of a candidate: an equals sign inside it ends a name, at its end it is padding.
PART = re.compile(r"=?[A-Za-z0-9+/_.~-]+(?:=+(?![A-Za-z0-9+/_.~-]))?")
RUN = re.compile(r"[A-Za-z0-9+/_.=~-]+")
LETTER_OR_DIGIT = re.compile(r"[A-Za-z0-9]")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: What a line of nothing but such strings does not hold: all but them, white space, quotes, brackets and marks of lists and comments.
OTHER = re.compile(r"""[^A-Za-z0-9+/_.=~\s"'`>|#*,;:()\[\]{}<\\-]""")
PEM_BEGIN, PEM_END = "-----BEGIN", "-----END"
PEM_HEADER = re.compile(r"[A-Za-z][A-Za-z-]*: ")
#: Line breaks of a PEM block, written out in quoted strings.
PEM_BREAK = re.compile(r"(?:\\r)?\\n|\\r|\n")
#: Characters of surrounding text on either side that the candidate is measured against.
AROUND = 400
#: Least marginal bytes for each character.
MIN_NOVELTY = 0.70
#: Least bits of a letter after the one before it, on average, for a candidate without digits.
MIN_BITS = 4.4

# The dictionary: identifiers and words that are usual in code and settings, so that they cost little.
DICTIONARY = """
access_key access_token account_id admin api_key api_secret apikey application/json array assert async auth auth_token
authorization await backend base64 bearer boolean bucket buffer callback certificate class client client_id client_secret
config connection const constructor container context controller cookie credential credentials customer data database
default delete deploy description development document domain element encoding encryption endpoint environment error
example exception export expires false field file filename filter float format frontend function gateway generate
github google handler hash header hostname http:// https:// identifier image import index input instance integer
interface internal iterator json key language length library license listener localhost location logger login manager
message metadata method middleware module monitor mysql namespace network node null number object oauth operation option
options order output package page param parameter parse passphrase password path payload permission platform plugin
policy port postgres prefix primary private private_key process production profile project property protocol provider
proxy public public_key python query queue random read redirect redis refresh_token region register release remote
render repository request resource response result return role root route runtime sample schedule schema scope script
secret secret_key security select sender sequence server service session session_id settings signature signing_key
socket source staging static status storage stream string struct subject submit suffix support system table target
template temporary test text thread timeout timestamp title token tracking transaction true type undefined update
upload url user user_id username utf-8 validate value variable version void webhook window worker workspace write
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 your_api_key_here changeme placeholder
"""
# Usual words of four languages: with the dictionary's, they tell which letter follows which.
USUAL_WORDS = """
the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one
you were all her she there would their we him been has when who will more no if out so said what up its about into
than them can only other new some could time these two may then do first any my now such like our over man me even
most made after also did many before must through back years where much your way well down should because each just
those people how too little state good very make world still own see men work long get here between both life being
under never day same another know while last might us great old year off come since against go came right used take
three states himself few house use during without again place american around however home small found thought went
say part once general high upon school every don does got united left number course war until always away something
fact though water less public put thing almost hand enough far took head yet government system better set told nothing
night end why called didn eyes find going look asked later knew point next program city business give group toward
young days let room within side social given several order national possible important development administration
understanding establishment representative international characteristic responsibility communication der die und den
von zu das mit sich des auf ist im dem nicht ein eine als auch es werden aus er hat dass sie nach wird bei einer um am
sind noch wie einem einen zum haben nur oder aber vor zur bis mehr durch sein wurde sei gegen vom schon wenn habe
seine mark ihre dann unter wir soll ich eines jahr zwei jahren diese dieser wieder keine uhr seiner worden zwischen
immer millionen sagte gesellschaft entwicklung geschwindigkeit verantwortung wissenschaft zusammenarbeit einheit keit
lich schaft de la le et les en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ont aux elle
leur mais comme nous cette deux tout ces fait peut entre sans aussi gouvernement mouvement eux ment tion el los del
las por con una su para al lo como pero sus ya o este porque esta cuando muy sin sobre hasta hay donde quien desde
todo nos durante todos uno ni contra otros ese eso ante ellos esto antes algunos unos yo otro otras otra tanto esa
estos mucho quienes nada muchos cual poco ella estar estas establecimiento responsabilidad conocimiento ciudad
gobierno desarrollo mente dad photo psycho crypto graphic hydro hyper jurisdiction whistle sport ship worth straight
forward propagation czech knowledge able rhythm abstract singleton proxy factory bean
"""


@cache
def _compressor() -> zstandard.ZstdCompressor:
    primer = zstandard.ZstdCompressionDict(DICTIONARY.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=12, dict_data=primer, write_content_size=False, write_checksum=False)


def _added(text: str, start: int, end: int, value: str) -> float:
    """Bytes that ``value`` adds to the compressed text around ``text[start:end]``, for each of its characters."""
    before, after = text[max(0, start - AROUND):start].encode(), text[end:end + AROUND].encode()
    compress = _compressor().compress
    around = after + b"\n" + before
    return (len(compress(around + value.encode())) - len(compress(around))) / len(value)


def novelty(text: str, start: int, end: int) -> float:
    """Bytes that ``text[start:end]`` adds to the compressed text around it, for each of its characters."""
    return _added(text, start, end, text[start:end])


@cache
def _bits() -> dict[str, float]:
    """The bits of each pair of letters, a word's edge being ^: the rarer the second is after the first, the more."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [w.lower() for w in WORD.findall(DICTIONARY.replace(letters, "").replace(letters.upper(), "") + USUAL_WORDS)]
    pairs = Counter(a + b for w in words for a, b in zip("^" + w, w))
    firsts = Counter(a for w in words for a in ("^" + w)[:-1])
    return {a + b: -log2((pairs[a + b] + 0.5) / (firsts[a] + 13)) for a in "^" + letters for b in letters}


def _looks_random(value: str) -> bool:
    """Whether a value holds a digit or its letters follow each other as in no usual word: prose is not novel."""
    if any(c.isdigit() for c in value):
        return True
    bits = _bits()
    found = [bits[a + b] for w in WORD.findall(value) for a, b in zip("^" + w.lower(), w.lower())]
    return bool(found) and sum(found) >= MIN_BITS * len(found)


def base_spans(text: str, lower: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, where the value starts) of the patterns' matches, by start and then kind."""
    found = []
    if any(w in lower for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def _runs(text: str, start: int, end: int) -> list[tuple[int, int]] | None:
    """The strings of a line that holds nothing else: one of any length or several candidates, none on a blank line."""
    if OTHER.search(text, start, end):
        return None
    runs = [m.span() for m in RUN.finditer(text, start, end) if LETTER_OR_DIGIT.search(text, *m.span())]
    return runs if len(runs) < 2 or all(e - s >= LEAST for s, e in runs) else None


def places(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whether in a PEM block) of the sensitive lines, in order.

    These are the lines with a sensitive word, the lines of nothing but candidates next to them on
    either side, blank ones between, and a PEM block to its END mark. A block without the mark goes
    on like any other line.
    """
    out, done, size, ends = [], 0, len(text), True

    def end_of(at):
        stop = text.find("\n", at)
        return size if stop < 0 else stop

    while (m := SENSITIVE.search(text, done)) is not None:
        first = max(text.rfind("\n", 0, m.start()) + 1, done)
        before, at = [], first
        while at > done:
            start = max(text.rfind("\n", 0, at - 1) + 1, done)
            if _runs(text, start, at - 1) is None:
                break
            before.append((start, at - 1, False))
            at = start
        out += reversed(before)
        stop = end_of(m.end())
        begin = text.find(PEM_BEGIN, first, stop)
        mark = text.find(PEM_END, begin) if begin >= 0 and ends else -1
        ends = ends and not (begin >= 0 and mark < 0)
        if mark >= 0:
            out += [(first, begin, False), (begin, mark, True)]
            done = mark + len(PEM_END)
            continue
        out.append((first, stop, False))
        while stop < size:
            start, stop = stop + 1, end_of(stop + 1)
            header = begin >= 0 and PEM_HEADER.match(text, start, stop)
            if _runs(text, start, stop) is None and not header or SENSITIVE.search(text, start, stop):
                stop = start - 1
                break
            out.append((start, stop, False))
        done = stop + 1
        if done > size:
            break
    return out


def _blocks(text: str) -> tuple[list[list[tuple[int, int]]], list[tuple[int, int]]]:
    """The sensitive lines as wrapped values, each the strings of its lines, and all other lines.

    The lines of a wrapped value are equally long, the last one at most as long.
    """
    wrapped, others, held = [], [], []

    def end():
        at = 0
        while at < len(held):
            length, stop = held[at][1] - held[at][0], at + 1
            while stop < len(held) and held[stop][1] - held[stop][0] == length:
                stop += 1
            if stop < len(held) and length >= LEAST and held[stop][1] - held[stop][0] < length:
                stop += 1
            wrapped.append(held[at:stop])
            at = stop
        held.clear()

    last = 0
    for start, stop, pem in places(text):
        if start > last + 1:
            end()
        at, last = start, stop
        for cut in [*([m.span() for m in PEM_BREAK.finditer(text, start, stop)] if pem else ()), (stop, stop)]:
            runs = _runs(text, at, cut[0])
            if runs and len(runs) == 1:
                held.append(runs[0])
            else:
                end()
                others.append((at, cut[0]))
            at = cut[1]
        if pem:
            end()
    end()
    return wrapped, others


def novel_spans(text: str, lower: str, taken: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Incompressible strings in sensitive places that no span of ``taken`` covers."""
    if not any(w in lower for w in SENSITIVE_WORDS):
        return []
    found = []
    starts, ends = [s for s, *_ in taken], list(accumulate((e for _, _, e, _ in taken), max))

    def new(start, end, value=None):
        value = text[start:end] if value is None else value
        return _added(text, start, end, value) >= MIN_NOVELTY

    def add(start, end):
        start += text[start] == "="
        at = bisect_right(starts, start)
        if not at or ends[at - 1] < end:
            found.append((start, 3, end, start))

    def random_and_new(start, end):
        return end - start >= LEAST and _looks_random(text[start:end]) and new(start, end)

    def measure(start, end):
        for m in CANDIDATE.finditer(text, start, end):
            parts = [p.span() for p in PART.finditer(text, m.start(), m.end())]
            reported = []
            for s, e in parts:
                if random_and_new(s, e):
                    reported.append((s, e))
                    continue
                # A name with a sensitive word makes its value look usual: what stands beside the word is measured alone.
                edges = [s, *[x for w in SENSITIVE.finditer(text, s, e) for x in w.span()], e]
                if len(edges) > 2:
                    reported += [piece for piece in zip(edges[::2], edges[1::2]) if random_and_new(*piece)]
            if not reported and len(parts) > 1 and random_and_new(*m.span()):
                reported.append(m.span())
            for s, e in reported:
                add(s, e)

    wrapped, others = _blocks(text)
    for runs in wrapped:
        value = "".join(text[s:e] for s, e in runs)
        if len(runs) > 2 and len(value) >= LEAST and _looks_random(value) and new(runs[0][0], runs[-1][1], value):
            for run in runs:
                add(*run)
            continue
        before = len(found)
        for s, e in runs:
            if e - s >= LEAST:
                measure(s, e)
            elif len(found) > before and _looks_random(text[s:e]) and new(s, e):  # the short end of the line before
                add(s, e)
    for start, stop in others:
        measure(start, stop)
    return found


def find(text: str) -> list[tuple[int, int, int, int]]:
    """All spans of one text by start, then kind."""
    lower = text.lower()
    base = base_spans(text, lower)
    return sorted(base + novel_spans(text, lower, base))


def written(spans, kinds=range(len(KINDS))) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans if k in kinds)


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Secrets of every whole text: counts of the base kinds, their digest and all spans.

    Columns ``keep``, then n_assign, n_access, n_hex, n_novel, base_sha256 and spans (kind:start:end
    in code points, end exclusive, by start and then kind, joined by commas). Null and empty texts
    have none. Rows stay as they are, repeated ones too; a kept column named like a result gives way.
    """

    def kernel(texts):
        found = [find(t) for t in texts]
        counts = [[sum(k == kind for _, k, _, _ in spans) for spans in found] for kind in range(4)]
        base = [hashlib.sha256(written(spans, range(3)).encode()).hexdigest() for spans in found]
        return [*counts, base, [written(spans) for spans in found]]

    return map_texts(docs, kernel, "n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string",
                     text, keep)


def hidden(text: str, mark: str = "[REDACTED]") -> str:
    """``text`` with the value of every secret replaced; the name before it stays."""
    out, at = [], 0
    for start, end in sorted((value, end) for _, _, end, value in find(text)):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with the secrets of ``text`` replaced, and ``n_chars`` set anew where that changed the text.

    All rows and columns stay; a null text stays null.
    """
    columns = docs.columns
    at, count = columns.index(text), columns.index(n_chars) if n_chars in columns else None

    def changed(batches):
        for batch in sliced(batches):
            texts = batch.column(at).to_pylist()
            new = [t if t is None else hidden(t) for t in texts]
            arrays = list(batch.columns)
            arrays[at] = pa.array(new, arrays[at].type)
            if count is not None:
                old = arrays[count].to_pylist()
                arrays[count] = pa.array([o if a == b else len(b) for o, a, b in zip(old, texts, new)], arrays[count].type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(changed, docs.schema)

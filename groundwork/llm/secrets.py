"""Secret scans: fixed credential patterns, and guess costs of the values in credential contexts."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import values

KINDS = ("assign", "access", "hex", "guess")
_WORDS = rb"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = re.compile(_WORDS + rb"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
#: Wider than the fixed pattern: more names for credentials, words between name and value, any value.
CONTEXT = re.compile(
    rb"(?i)(?:(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|bearer)[\"']?"
    rb"(?:\x20*(?::=|=>|[:=])\x20*|\x20+(?:is|was)\x20+)|bearer\x20+)[\"'`]?([^\s\"'`<>,;]+)"
)
_ASSIGN_HINTS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
_HINTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"bearer")

#: Common passwords and words, most guessed first; a word's rank is its guess number.
COMMON = (
    "password 123456 qwerty admin letmein welcome login monkey dragon master abc123 iloveyou sunshine princess "
    "football baseball shadow superman michael jordan trustno1 secret changeme default guest root test user "
    "example sample demo temp temporary dummy null none true false placeholder your key token value string here "
    "insert replace enter hello world summer winter spring autumn monday friday january march april june july "
    "august october december love money house green orange black white silver gold hunter killer soccer hockey "
    "computer internet server database access system manager private public service account office company "
    "the and for are with that this from have not you all was one our out day get has him his how man new now "
    "old see two way who boy did its let put say she too use that time year people good some could them other "
    "than then look only come over think also back after work first well even want because any these give most"
).split()
#: Words that prose has after the name of a credential, then parts of longer words.
PLAIN = (
    "required important confidential protected encrypted decrypted invalid valid incorrect correct expired missing "
    "unknown hidden shared stored saved created updated deleted removed changed reset provided generated random unique "
    "strong weak needed optional available unavailable disabled enabled blocked locked unlocked allowed denied rejected "
    "accepted approved granted revoked refreshed renewed rotated issued signed verified validated checked tested "
    "compromised leaked stolen exposed public private internal external local global shared common simple complex "
    "sensitive secure insecure safe unsafe authenticated authorized unauthorized authentication authorization "
    "authenticate authorize credential credentials certificate signature encryption decryption security "
    "administrator username password passphrase passcode identifier identity session cookie header payload request "
    "response message application environment variable configuration parameter argument function method class object "
    "property attribute element container kubernetes cluster namespace repository directory document reference "
    "development production staging testing deployment integration implementation description definition information "
    "instruction documentation specification organization registration subscription permission connection transaction "
    "production operation collection generation expiration validation verification notification communication "
    "something anything everything nothing somewhere anywhere everyone anyone someone nobody already always never "
    "usually sometimes currently previously immediately automatically manually temporarily permanently originally "
    "probably possibly certainly definitely actually basically simply easily quickly carefully properly correctly "
    "because although however therefore otherwise without within between through during before against another "
    "different similar identical separate several multiple single double triple number letter character symbol digit "
    "minimum maximum length shorter longer greater smaller higher lower better worse longest shortest "
    "whatever whoever whenever wherever whether either neither both little large small great right wrong "
    "written printed displayed shown listed described mentioned contained included excluded attached appended "
    "encoded decoded hashed salted masked redacted obfuscated plaintext cleartext transmitted received delivered "
    "returned obtained requested submitted entered typed copied pasted forgotten remembered recovered restored "
    "supposed expected intended designed considered regarded called named known given taken found located kept "
    "used uses using user users being been were will would should must might cannot until since upon about around "
    "again once often rather quite almost enough further himself herself itself themselves yourself "
    "business company customer employee personal network website address account balance payment "
    "question answer problem solution example sample template default placeholder replace insert undefined "
    "string integer boolean number float double array object nullable anonymous guest visitor member "
    "morning evening afternoon yesterday tomorrow tonight children family friend teacher student school university "
    "freedom happiness knowledge success failure experience difference beginning ending story history science nature "
    "tion ation ition sion ment ness able ible ing ings less ful ity ally ical ially ance ence ized ised izing ising "
    "est ers ist ism ive ous ish ward wise ship hood pre post inter intra trans over under counter super multi "
    "non mis dis auto self anti semi sub cor con per pro "
).split()
RANKS = {w: k for k, w in reversed(list(enumerate(dict.fromkeys(COMMON + PLAIN), 1)))}
_LONGEST = max(map(len, RANKS))
_LEET = str.maketrans("4@831!|05$7+2", "aabeiilossttz")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01]))?|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:19|20)?\d\d")
_DATE_SIZES = range(4, 11)
#: Rows of a keyboard, plain and shifted, and how far right each starts, in keys.
_ROWS = (
    ("`1234567890-=", "~!@#$%^&*()_+", 0.0), ("qwertyuiop[]\\", "QWERTYUIOP{}|", 1.5), ("asdfghjkl;'", 'ASDFGHJKL:"', 1.75),
    ("zxcvbnm,./", "ZXCVBNM<>?", 2.25),
)
_KEYS = {c: (r, k + left, shift) for r, (plain, upper, left) in enumerate(_ROWS) for shift, row in enumerate((plain, upper)) for k, c in enumerate(row)}
_PERIODS = (1, 2, 3, 4)


def step_of(a: str, b: str) -> tuple[int, int] | None:
    """The direction from one key to one beside it, rows down and keys right; None if they aren't neighbours."""
    if a not in _KEYS or b not in _KEYS:
        return None
    (r, x, _), (s, y, _) = _KEYS[a], _KEYS[b]
    if abs(r - s) > 1 or not 0 < abs(x - y) <= 1:
        return None
    return s - r, 1 if y > x else -1


def char_bits(c: str) -> float:
    """Bits of one brute-forced character."""
    if c.isascii():
        return math.log2(10 if c.isdigit() else 26 if c.isalpha() else 33)
    return 8.0


def word_bits(low: str, plain: str, raw: str) -> float:
    """Bits of a dictionary word by rank, capitals and look-alike characters; infinite for any other text."""
    rank, extra = RANKS.get(low), 0.0
    if rank is None:
        rank, extra = RANKS.get(plain), 2.0
    if rank is None:
        return math.inf
    caps = sum(c.isupper() for c in raw)
    if caps:
        extra += 1.0 if caps == len(raw) or (caps == 1 and raw[0].isupper()) else caps + 1.0
    return math.log2(rank + 1) + extra + 1


def date_bits(text: str) -> float:
    """Bits of a year or a whole date; infinite for any other text."""
    if not _DATE.fullmatch(text):
        return math.inf
    return (math.log2(150) if len(text) == 4 else math.log2(150 * 365) + 2) + 1


def repeat_bits(n: int) -> float:
    """Bits of any number of copies of the one to four characters before them, within a value of ``n`` characters."""
    return math.log2(n) + 3


def walk_bits(n: int) -> float:
    """Bits of a keyboard walk before its turns: its first key, its length within ``n`` characters, its place."""
    return math.log2(47) + math.log2(n) + 1


#: Bits of each direction that a walk takes, the first among them, and of each change of the shift key.
TURN_BITS, SHIFT_BITS = 2.0, 1.0


def guess_bits(value: str, enough: float = math.inf) -> float:
    """log2 of the guesses that the cheapest segmentation of ``value`` needs, exactly; 0 for an empty value.

    Segments are dictionary words, dates, repeats of what stands before them, keyboard walks and brute-force
    characters, of every start and length. Repeats and walks are states that go on from character to character, so time is
    linear in the length. Once nothing that is open costs less than ``enough``, the rest isn't read and at least
    ``enough`` is returned.
    """
    n = len(value)
    if not n:
        return 0.0
    low = value.lower()
    plain = low.translate(_LEET) if len(low) == n else low
    low, plain = (low, plain) if len(low) == n and len(plain) == n else (value, value)
    repeated, walked = repeat_bits(n), walk_bits(n)
    best = [0.0]
    runs = dict.fromkeys(_PERIODS, math.inf)
    walks: dict[tuple[int, int] | None, float] = {}  # cost by the direction last taken; None where only the first key was
    window = max(_LONGEST, _DATE_SIZES[-1])
    for k, c in enumerate(value):
        end = k + 1
        least = best[k] + char_bits(c)
        for start in range(max(0, end - _LONGEST), end - 2):
            least = min(least, best[start] + word_bits(low[start:end], plain[start:end], value[start:end]))
        if c.isdigit():
            for size in _DATE_SIZES:
                if size <= end and value[end - size].isdigit():
                    least = min(least, best[end - size] + date_bits(value[end - size : end]))
        for p in _PERIODS:
            runs[p] = min(runs[p], best[k]) if k >= p and c == value[k - p] else math.inf
            least = min(least, runs[p] + repeated)
        walks = _walked_on(walks, value[k - 1] if k else "", c)
        walks[None] = best[k] + walked if c in _KEYS else math.inf
        least = min(least, *walks.values())
        best.append(least)
        if enough < math.inf and min(*best[-window:], *runs.values(), *walks.values()) >= enough:
            return max(enough, least)
    return best[n]


def _walked_on(walks: dict, before: str, c: str) -> dict:
    """The open walks after one more key."""
    way = step_of(before, c) if before else None
    if way is None:
        return {}
    cost = min(x if last == way else x + TURN_BITS for last, x in walks.items())
    return {way: cost + (SHIFT_BITS if _KEYS[before][2] != _KEYS[c][2] else 0.0)}


def _assigned(body: bytes) -> list[tuple[int, int]]:
    return [m.span() for m in ASSIGN.finditer(body) if m.end(1) - m.start(1) >= 6]


def spans_of(body: bytes, min_bits: float = 40.0) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of all secrets in a UTF-8 text, in bytes, by start and kind."""
    low = body.lower()
    found = []
    if any(h in low for h in _ASSIGN_HINTS):
        found += [(*s, 0) for s in _assigned(body)]
    if b"AKIA" in body:
        found += [(*m.span(), 1) for m in ACCESS.finditer(body)]
    found += [(*m.span(), 2) for m in HEX.finditer(body)]
    if any(h in low for h in _HINTS):
        at = 0
        while m := CONTEXT.search(body, at):
            at = m.start(1)  # the value may begin another context, as in "bearer token: ..."
            value = m[1].rstrip(b".!?)]}")
            text = value.decode("utf-8", "replace")
            if len(text) >= 6 and guess_bits(text, min_bits) >= min_bits:
                at = m.start(1) + len(value)
                found.append((m.start(1), at, 3))
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def _points(body: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets as code points; the text is walked once."""
    if body.isascii():
        return spans
    place, at, count = {}, 0, 0
    for edge in sorted({e for s in spans for e in s[:2]}):
        count += len(body[at:edge].decode("utf-8", "replace"))
        place[edge], at = count, edge
    return [(place[s], place[e], k) for s, e, k in spans]


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bits: float = 40.0) -> DataFrame:
    """(id, spans array<struct<kind, start, end>>), one row per row of ``df``, code points, end exclusive.

    Fixed patterns come first and stay. The method adds ``guess`` spans: values in a credential context whose
    cheapest guess still costs ``min_bits`` bits, so words, dates and keyboard walks aren't reported; values of six
    characters or more are judged by that cost alone, letters only and digits only among them. Words are English. Spans are
    ordered by start, then kind as in KINDS. Null and empty texts have none; texts are searched whole, however long
    they or a value are; repeated rows and null ids are rows like any other, an empty table gives none.
    """
    kind = dict(df.select(F.col(id_col).alias("id")).dtypes)["id"]
    schema = f"id {kind}, spans array<struct<kind:string,start:int,end:int>>"
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body in values(batch.column(1)):
                got = spans_of(body, min_bits) if body else []
                out.append([{"kind": KINDS[k], "start": s, "end": e} for s, e, k in (_points(body, got) if got else [])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, item)], ["id", "spans"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("body"))
    return source.mapInArrow(run, schema)

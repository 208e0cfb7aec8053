"""Personal data and secrets replaced by keyed surrogates of the same type and format."""

from __future__ import annotations

import hashlib
import re
import secrets
import sys

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, new_name, read_table, stored

#: What introduces a secret's value, and titles with the gender they tell.
_SECRET_WORDS = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|authorization|auth"
_FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Doña|Signora|Госпожа|Κυρία"
_MALE = "Mr|Herr|Monsieur|Señor|Sr|Don|Signor|Господин|Κύριος"

_CAPITALS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isupper() and c.isalpha())
# A capitalised word, also in the case-blind pattern.
_CAP = rf"(?-i:[{_CAPITALS}])[^\W\d_]{{1,30}}"
# A name: a capitalised word, maybe a double one; before the first there may be initials, which tell nothing and stay.
_NAME = rf"(?:(?-i:[{_CAPITALS}])['’])?{_CAP}(?:['’\-]{_CAP})?"
_NAMES = rf"(?:(?-i:[{_CAPITALS}])\.\ ?){{0,2}}{_NAME}(?:\ (?:(?-i:[{_CAPITALS}])\.\ ?)?{_NAME}){{0,2}}"
_PATTERN = re.compile(
    rf"""(?P<email>(?<![\w.%+\-])[\w.%+\-]+@[\w\-]+(?:\.[\w\-]+)*\.[^\W\d_]{{2,}}(?![\w\-]))
    |(?P<ipv6>(?<![\w:])(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}(?![\w:]))
    |(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d))
    |(?P<ssn>(?<![\w\-])\d{{3}}-\d{{2}}-\d{{4}}(?![\w\-]))
    |(?P<iban>(?<!\w)[A-Za-z]{{2}}\d{{2}}(?:\ ?[A-Za-z0-9]{{4}}){{2,7}}(?:\ ?[A-Za-z0-9]{{1,4}})?(?!\w))
    |(?P<card>(?<![\w+])\d(?:[\ \-]?\d){{12,18}}(?![\w\-]))
    |(?P<phone>(?<![\w+])(?:\+\d{{1,3}}[\ .\-]?)?(?:\(\d{{2,4}}\)[\ .\-]?\d{{3,4}}[\ .\-]?\d{{3,4}}|\d{{3}}[.\-]\d{{3}}[.\-]\d{{4}})(?!\w)
        |\+\d{{1,3}}(?:[\ .\-]?\d{{2,4}}){{2,5}}(?!\w))
    |(?P<key>(?<!\w)(?:AKIA|ASIA)[0-9A-Za-z]{{16}}(?!\w)|(?<!\w)(?:gh[pousr]_|xox[abpr]-|sk-|glpat-)[\w\-]{{16,}}|(?<!\w)eyJ[\w\-]{{8,}}\.[\w\-]{{8,}}\.[\w\-]{{8,}})
    |(?:(?<=://)[^\s/:@]+:(?P<login>[^\s/@]+)(?=@))
    |(?:(?<!\w)(?:(?:{_SECRET_WORDS})["']?\s{{0,3}}[=:]\s{{0,3}}["']?(?:bearer\ +)?|bearer\ +(?=\S*\d))(?P<secret>[\w+/.~\-]{{6,}}=?=?))
    |(?:(?<!\w)(?P<f>{_FEMALE})\.?\ (?P<woman>{_NAMES}))
    |(?:(?<!\w)(?P<m>{_MALE})\.?\ (?P<man>{_NAMES}))
    |(?P<hex>(?<!\w)(?=[a-f]*\d)(?:[0-9a-f]{{32,}})(?!\w))""",
    re.VERBOSE | re.IGNORECASE,
)
_KINDS = ("email", "ipv6", "ip", "ssn", "iban", "card", "phone", "key", "secret", "login", "woman", "man", "hex")
# The line of every entity but a titled name and a key holds one of these; those two have their own beginnings. Only such
# lines meet the pattern.
_HEAD = re.compile("AKIA|ASIA|gh[pousr]_|xox[abpr]-|sk-|glpat-|eyJ|", re.IGNORECASE)
_ANCHOR = re.compile(r"[\d@=:]")
_TITLES = [f"{w.lower().replace('ς', 'σ')}{end}" for w in f"{_FEMALE}|{_MALE}".split("|") for end in (" ", ". ")]
_KEYS = ["akia", "asia", *(f"gh{c}_" for c in "pousr"), *(f"xox{c}-" for c in "abpr"), "sk-", "glpat-", "eyj", "bearer "]
# A private key's block: its lines between the marks, of which the last may be short; line ends may be written as \\n.
_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?:\s|\\n)*(?P<body>(?:[A-Za-z0-9+/=]{16,}(?:\s|\\n)+)*[A-Za-z0-9+/=]{4,})")


def _lower(text: str) -> str:
    """Lower case, character by character, with the letters that a case-blind pattern takes for i, s and σ."""
    return text.replace("İ", "i").replace("ı", "i").replace("ſ", "s").lower().replace("ς", "σ")


def _starts(text: str) -> list[int]:
    """Where a title before a capital, or the beginning of a key, stands at a word's start."""
    low, found = _lower(text), []
    for begin, name in [(t, True) for t in _TITLES] + [(k, False) for k in _KEYS]:
        at = low.find(begin)
        while at >= 0:
            then = text[at + len(begin) : at + len(begin) + 1]
            if (then.isupper() if name else then.isalnum() or then in ("_", "-")) and not (at and (low[at - 1].isalnum() or low[at - 1] == "_")):
                found.append(at)
            at = low.find(begin, at + 1)
    return found


def _lines(text: str) -> list[tuple[int, int]]:
    """The lines that may hold an entity."""
    at = sorted([m.start() for m in _ANCHOR.finditer(text)] + _starts(text))
    lines: list[tuple[int, int]] = []
    end = -1
    for x in at:
        if x >= end:
            end = text.find("\n", x)
            end = len(text) if end < 0 else end
            lines.append((text.rfind("\n", 0, x) + 1, end))
    return lines


_WORD = re.compile(rf"(?<!\w){_NAME}(?!\w)")


def mentions(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, identity) of each entity. Mentions of one thing in several formats share their identity.

    A blank to be filled in, with neither letter nor digit, is no secret and no key. A titled name is taken by its words:
    the last one is a surname, those before it are given names of the title's gender. Once a name is known in a text, all
    its capitalised occurrences there are mentions, with or without title.
    """
    found, titled = [], []
    blocks = [m.span("body") for m in _BLOCK.finditer(text)] if text and "PRIVATE KEY-----" in text else []
    for begin, end in _lines(text or ""):
        for m in _PATTERN.finditer(text, begin, end):
            kind = next(k for k in _KINDS if m.group(k) is not None)
            if blocks and any(a < m.end(kind) and m.start(kind) < b for a, b in blocks):
                continue
            if kind == "login":
                found.append((*m.span(kind), "secret", identity("secret", m[kind])))
                continue
            if kind in ("woman", "man"):
                titled.append((kind, [(w.start(), w.end()) for w in _WORD.finditer(text, *m.span(kind))]))
            elif kind not in ("key", "secret") or any(map(str.isalnum, m[kind][len(_head(kind, m[kind])) :])):
                found.append((*m.span(kind), kind, identity(kind, m[kind])))
    found = sorted(found + [(a, b, "secret", text[a:b]) for a, b in blocks])
    if not titled:
        return found
    kind_of: dict[str, str] = {}
    for kind, spans in titled:
        for a, b in spans[:-1]:
            kind_of.setdefault(text[a:b].lower(), kind)
    for _, spans in titled:
        for a, b in spans[-1:]:
            kind_of.setdefault(text[a:b].lower(), "surname")
    named, at = [], 0
    taken = sorted(found)
    for w in _WORD.finditer(text):
        kind = kind_of.get(w[0].lower())
        while at < len(taken) and taken[at][1] <= w.start():
            at += 1
        if kind and not (at < len(taken) and taken[at][0] < w.end()):
            named.append((*w.span(), kind, w[0].lower()))
    return sorted(found + named)


def _head(kind: str, mention: str) -> str:
    """What a key begins with, whatever its holder."""
    return _HEAD.match(mention)[0] if kind == "key" else ""


def identity(kind: str, mention: str) -> str:
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", mention)
    if kind == "phone":
        return re.sub(r"\D", "", mention)[-10:]
    if kind == "iban":
        return mention.replace(" ", "").upper()
    if kind == "ip":
        return ".".join(str(int(x)) for x in mention.split("."))
    if kind in ("key", "secret") and not re.fullmatch("[0-9a-fA-F]+", mention):
        return mention
    return mention.lower()


class _Stream:
    """Keyed pseudo-random numbers of an identity."""

    def __init__(self, key: bytes, *parts: str) -> None:
        key = key if len(key) <= 64 else hashlib.blake2b(key).digest()
        self.seed, self.n, self.left = hashlib.blake2b("\x1f".join(parts).encode(), key=key).digest(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hashlib.blake2b(self.seed + self.n.to_bytes(4, "big")).digest()
            self.n += 1
        x, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return x % n


#: Letters of each script, lower case.
_SCRIPTS = ["abcdefghijklmnopqrstuvwxyz", "àáâäçèéêëìíîïñòóôöùúûüÿ", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзиклмнопрстуфхцчшэюя"]
_SYLLABLES = {"Latin": ("bdfgklmnprstv", "aeiou"), "Greek": ("βγδζθκλμνπρστ", "αειου"), "Cyrillic": ("бвгдзклмнпрст", "аеиоу")}


def _shaped(text: str, r: _Stream, hexadecimal: bool = False) -> str:
    """A text of the same shape: digits for digits and other numerals, letters of the same script and case for letters, the
    rest as it is."""
    out = []
    for c in text:
        low = c.lower()
        script = next((s for s in _SCRIPTS if low in s), "")
        if c.isdecimal():
            out.append(chr(ord(c) - int(c) + r.below(10)))
        elif c.isnumeric() and not c.isalpha():
            out.append("0123456789"[r.below(10)])
        elif script:
            new = "abcdef"[r.below(6)] if hexadecimal else script[r.below(len(script))]
            out.append(new.upper() if c != low else new)
        elif c.isalpha():
            out.append("abcdefghijklmnopqrstuvwxyz"[r.below(26)])
        else:
            out.append(c)
    return "".join(out)


def _luhn(digits: str) -> int:
    """The check digit for a number's leading digits."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


#: Attempts that keep the size of a secret, a key or a phone number, and the attempt whose surrogate is unique by itself.
_SAME_SIZE = 4
LAST_ATTEMPT = 40
#: Kinds whose surrogates must differ from each other's too.
_SPACE = {"woman": "name", "man": "name", "surname": "name"}


def surrogate(kind: str, ident: str, attempt: int, key: bytes) -> str:
    """The identity that replaces this one. Attempts above 0 serve identities whose earlier surrogate was taken.

    Names grow by a syllable an attempt; secrets, keys and phone numbers, which can be short, by a character an attempt
    after the first few. The last attempt carries 64 keyed bits, so that even a format that is full has a surrogate: it is
    longer than the mention then (an IPv4 address becomes one of the documentation's IPv6 addresses).
    """
    r = _Stream(key, kind, ident, str(attempt))
    if attempt >= LAST_ATTEMPT:
        return _unique(kind, ident, r)
    new = ident
    for _ in range(32):
        new = _surrogate(kind, ident, r, attempt)
        if kind in ("key", "secret", "phone"):
            signs = "0123456789" if kind == "phone" else "0123456789abcdef"
            new += "".join(signs[r.below(len(signs))] for _ in range(attempt - _SAME_SIZE))
        if new != ident:
            return new
    return _unique(kind, ident, r)


def _unique(kind: str, ident: str, r: _Stream) -> str:
    if kind in ("ip", "ipv6"):
        return "2001:db8:" + ":".join(f"{r.below(1 << 16):x}" for _ in range(6))
    if kind in _SPACE:
        return _name(ident, kind, r, 10)
    if kind == "email":
        return f"m{''.join('0123456789abcdef'[r.below(16)] for _ in range(16))}.{_surrogate(kind, ident, r, 0)}"
    signs = "0123456789" if kind in ("card", "ssn", "phone", "iban") else "0123456789abcdef"
    return _surrogate(kind, ident, r, 0) + "".join(signs[r.below(len(signs))] for _ in range(20))


def _surrogate(kind: str, ident: str, r: _Stream, attempt: int) -> str:
    if kind == "email":
        local, _, domain = ident.partition("@")
        labels = domain.split(".")
        # reserved domains, so no surrogate reaches a real mailbox
        return f"{_shaped(local, r)}@{'.'.join([_shaped(x, r) for x in labels[:-2]] + [f'm{r.below(10**6)}', 'example', ('com', 'net', 'org')[r.below(3)]])}"
    if kind == "ip":
        return ".".join(str(1 + r.below(254)) for _ in range(4))
    if kind == "card":
        body = ident[0] + _shaped(ident[1:-1], r)
        return body + (str(_luhn(body)) if ident[-1] == str(_luhn(ident[:-1])) else str(r.below(10)))
    if kind == "iban":
        return ident[:2] + _shaped(ident[2:], r)
    if kind in _SPACE:
        return _name(ident, kind, r, attempt)
    if kind == "key":
        head = _head(kind, ident)
        return head + _shaped(ident[len(head) :], r)
    return _shaped(ident, r, bool(re.fullmatch("[0-9a-f]+", ident)))


def _name(word: str, kind: str, r: _Stream, more: int) -> str:
    """A made-up name in the word's script, longer by some syllables.

    Given names end as the gender's names commonly do; a surname keeps its last vowel, as endings may tell the gender, or
    ends in a consonant. A double name stays double.
    """
    for sign in "-'’":
        if sign in word[1:-1]:
            a, _, b = word.partition(sign)
            return f"{_name(a, kind, r, more)}{sign}{_name(b, kind, r, 0)}"
    script = "Cyrillic" if re.search("[а-я]", word) else "Greek" if re.search("[α-ω]", word) else "Latin"
    consonants, vowels = _SYLLABLES[script]
    base = "".join(consonants[r.below(len(consonants))] + vowels[r.below(len(vowels))] for _ in range(max(2, (len(word) + 1) // 2) + more))
    if kind == "woman":
        return base[:-1] + vowels[0]
    return base[:-1] + word[-1] if kind == "surname" and word[-1] in vowels else base + consonants[r.below(len(consonants))]


def render(kind: str, mention: str, new: str) -> str:
    """The new identity in the mention's own format: its separators, its letter case, its country code."""
    if kind in ("card", "ssn", "phone"):
        spots = [i for i, c in enumerate(mention) if c.isdecimal()][-(10 if kind == "phone" else len(new)) :]
        out = list(mention)
        for i, c in zip(spots, new, strict=False):
            out[i] = c
        return "".join(out) + new[len(spots) :]
    if kind == "iban":
        out, at = [], iter(new)
        for c in mention:
            out.append(c if c == " " else next(at).lower() if c.islower() else next(at))
        return "".join(out)
    if kind in _SPACE:
        return new.upper() if mention.isupper() else re.sub(r"[^\W\d_]+", lambda m: m[0].capitalize(), new)
    return new.upper() if mention.isupper() and mention.upper() != mention.lower() else new


def replace(text: str | None, attempts: dict[str, int] | None, key: bytes) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with every mention replaced, and (start, end, kind) of the replacements in it."""
    out, spans, at, size = [], [], 0, 0
    for start, end, kind, ident in mentions(text):
        new = render(kind, text[start:end], surrogate(kind, ident, (attempts or {}).get(f"{kind}\x1f{ident}", 0), key))
        out += [text[at:start], new]
        size += start - at
        spans.append((size, size + len(new), kind))
        size += len(new)
        at = end
    return ("".join([*out, text[at:]]), spans) if spans else (text, [])


def _entities(docs: DataFrame, text_col: str) -> DataFrame:
    out = pa.schema([("place", pa.int64()), ("kind", pa.string()), ("ident", pa.string())])

    def run(batches):
        for b in batches:
            rows = [(h, k, i) for t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, i in sorted({m[2:] for m in mentions(t)})]
            yield batch(out, *([list(c) for c in zip(*rows, strict=True)] if rows else ([], [], [])))

    return arrow_map(docs.where(F.col(text_col).isNotNull()).select(text_col, F.xxhash64(text_col).alias("place")), run, "place bigint, kind string, ident string")


def _given(entities: DataFrame, key: bytes) -> DataFrame:
    out = pa.schema([("kind", pa.string()), ("ident", pa.string()), ("attempt", pa.int32()), ("space", pa.string()), ("new", pa.string())])

    def run(batches):
        for b in batches:
            kind, ident, attempt = (c.to_pylist() for c in b.columns)
            yield batch(out, kind, ident, attempt, [_SPACE.get(k, k) for k in kind], [surrogate(k, i, a, key) for k, i, a in zip(kind, ident, attempt, strict=True)])

    return arrow_map(entities.select("kind", "ident", "attempt"), run, "kind string, ident string, attempt int, space string, new string")


def taken_again(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, ident, attempt) of the identities whose first surrogate collides: with another's, or with a real identity.

    Rounds repeat until none collides, at most LAST_ATTEMPT of them: the last attempt's surrogates are unique. The smallest
    identity keeps a contested surrogate; the others draw again. All kinds of names share one space of surrogates.
    """
    now = entities.withColumn("attempt", F.lit(0))
    space = F.when(F.col("kind").isin(*_SPACE), "name").otherwise(F.col("kind"))
    real = entities.select(space.alias("space"), F.col("ident").alias("new")).distinct().withColumn("real", F.lit(True))
    while True:
        given = stored(_given(now, key), "surrogates")
        # a surrogate that others keep: the smallest identity among those that share it
        mine = F.struct("kind", "ident")
        first = given.groupBy("space", "new").agg(F.min(mine).alias("keeper"), F.count("*").alias("n"))
        clash = first.join(real, ["space", "new"], "left").where("n > 1 or real")
        again = given.where(F.col("attempt") < LAST_ATTEMPT).join(clash, ["space", "new"]).where(F.col("real") | (mine != F.col("keeper"))).select("kind", "ident", F.lit(1).alias("more"))
        again = stored(again, "clashes")
        if again.isEmpty():
            return given.where("attempt > 0").select("kind", "ident", "attempt")
        now = stored(given.join(again, ["kind", "ident"], "left").select("kind", "ident", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")), "attempts")


def anonymise(docs: DataFrame, key: bytes, text_col: str = "text", entities_col: str | None = "entities") -> DataFrame:
    """docs with surrogates in text_col, and entities_col array<struct<start, end, kind>> in the new text's characters.

    One identity gets one surrogate over the whole corpus, two never share one, and none equals an identity that occurs;
    so ties do not arise. Surrogates follow from the key, so only identities that had to draw again travel to the rows
    that mention them, by the text's hash; Spark broadcasts that table only below its own size threshold. Null texts stay
    null and empty ones empty, with no entities; rows repeat; other columns stay as they are, but one of docs that has
    entities_col's name is replaced. entities_col None: no such column is made.
    """
    if not key:
        raise ValueError("surrogates need a key")
    rows = stored(_entities(docs, text_col), "mentions")
    moved = taken_again(rows.select("kind", "ident").distinct(), key)
    by_text = rows.join(moved, ["kind", "ident"]).groupBy("place").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\x1f", "kind", "ident"), "attempt"))).alias("attempts"))
    place, attempts = new_name(docs, "place"), new_name(docs, "attempts")
    by_text = stored(by_text, "moved").toDF(place, attempts)
    fields = [f for f in docs.schema.fields if f.name not in (text_col, entities_col)]
    keep = [f"`{f.name}`" for f in fields]
    # null texts never match; a number of their own keeps them from meeting in one task
    at = F.when(F.col(f"`{text_col}`").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(f"`{text_col}`"))
    joined = docs.withColumn(place, at).join(by_text, place, "left").select(*keep, f"`{text_col}`", attempts)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{text_col}` string"] + [f"`{entities_col}` array<struct<start:int,end:int,kind:string>>"] * bool(entities_col))
    entity = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    names = [*(f.name for f in fields), text_col, *[entities_col] * bool(entities_col)]

    def run(batches):
        for b in batches:
            n = b.num_columns
            done = [replace(t, dict(a) if a else None, key) for t, a in zip(b.column(n - 2).to_pylist(), b.column(n - 1).to_pylist(), strict=True)]
            out = [pa.array([t for t, _ in done], pa.string())]
            if entities_col:
                out.append(pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in x] for _, x in done], entity))
            yield pa.RecordBatch.from_arrays([*b.columns[: n - 2], *out], names=names)

    return arrow_map(joined, run, schema)


def session_key(spark) -> bytes:
    """The key in the session's `tessera.pii.key`. A session without one gets a random key of its own, which is kept there:
    nobody can undo its surrogates, and they are alike within the session only."""
    key = spark.conf.get("tessera.pii.key", None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set("tessera.pii.key", key)
    return key.encode()


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, its text with surrogates, how many entities were replaced and of which kinds.

    Null texts stay null (no entities), empty ones empty; repeated rows repeat; an empty table gives an empty one.
    """
    done = anonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
    return done.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.concat_ws(",", F.sort_array(F.array_distinct("entities.kind"))).alias("kinds"))

"""Surrogates for personal data.

Detected entities are replaced by keyed surrogates of the same type, script and format.  A surrogate
is the image of the entity under a keyed permutation of all strings of its format, so one entity has
one surrogate in the whole corpus, and two entities of one format never share one, without any table
of what has been seen.  The permutation is a conjugated rotation (encrypt, add one, decrypt): it has
no fixed point, so an entity is never its own surrogate.  Given names are permuted within the list of
their gender and script; a name outside the lists, or with a title of another gender, keeps its
pattern of vowels and consonants and its ending, which tells its gender, and walks on until its image
is outside the lists too, so the two kinds can't collide.  Check digits of cards and account numbers
are computed anew.  The words of a name that a text has named in full are replaced wherever they
stand in that text.

``collisions`` lists the surrogates of a corpus that are entities of it themselves.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, map_batches

ROUNDS = 8

#: Given names by script and gender.
NAMES = {
    ("latin", "f"): "Agnieszka Aisha Alice Anjali Anna Barbara Carmen Catherine Charlotte Chloe Claudia Elena Elizabeth Emily Emma Fatima Ingrid Isabel Jennifer Julia Karen Laura Lucia Maria Marie Mary Nancy Patricia Priya Sarah Sofia Susan Ursula Zofia".split(),
    ("latin", "m"): "Ahmed Andreas Antonio Arjun Carlos Charles Daniel David Francisco Hans Hiroshi Ibrahim James Javier Jean John Jose Juan Karl Kenji Luis Michael Michel Miguel Mohammed Paul Peter Pierre Piotr Rahul Richard Robert Thomas William Xaver".split(),
    ("cyrillic", "f"): "Александра Анастасия Анна Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Владимир Дмитрий Иван Максим Михаил Николай Павел Сергей Юрий".split(),
    ("greek", "f"): "Αικατερίνη Βασιλική Γεωργία Ελένη Ιωάννα Μαρία Παναγιώτα Σοφία".split(),
    ("greek", "m"): "Αθανάσιος Βασίλειος Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Νικόλαος Παναγιώτης".split(),
}
#: Common Chinese family names and characters of given names, titles that follow a name, and endings of family names.
HAN_FAMILY, HAN_GIVEN = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗", "明华伟芳娜敏静丽强军杰娟涛超平刚桂英建国文玉红春梅海燕波辉"
HAN_TITLES = "先生|女士|小姐|老师|教授"
ENDINGS = ("dóttir", "sdotter", "ski", "ska", "cki", "cka", "ov", "ova", "owa", "ev", "eva", "ский", "ская", "ов", "ова", "ев", "ева", "ин", "ина", "ίδης", "ίδου", "όπουλος", "οπούλου")
#: Letters that sound alike: a letter of a name becomes another one of its set.
VOWELS = ("aeiou", "àáâãäåèéêëìíîïòóôõöùúûüý", "аеёиоуыэюя", "αεηιουω", "άέήίόύώ")
CONSONANTS = ("bcdfghjklmnprstvwyz", "qx", "бвгджзклмнпрстфхцчшщ", "йъь", "βγδζθκλμνξπρστφχψ")
#: Titles and the gender they tell.
TITLES = {"Mr.": "m", "Herr": "m", "Señor": "m", "Monsieur": "m", "господин": "m", "κύριος": "m", "Mrs.": "f", "Ms.": "f", "Miss": "f", "Frau": "f", "Señora": "f", "Mme.": "f", "Madame": "f", "госпожа": "f", "κυρία": "f", "Dr.": "", "Prof.": ""}
GENDER = {name: (kind, names) for kind, names in NAMES.items() for name in names}

CAPITAL = r"[^\W\d_a-zà-öø-ÿа-яα-ω][^\W\d_]+"
LISTED = "|".join(sorted(GENDER, key=len, reverse=True))
PATTERNS = [
    ("secret", r"""(?i:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}["']?(?P<secret>[\w+/=-]{12,})"""),
    ("email", r"(?P<email>(?<![\w.%+-])[\w%+-][\w.%+-]{0,63}@[\w-]+(?:\.[\w-]+)+)"),
    ("iban", r"(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{4}){3,7}[A-Z0-9]{0,3}(?!\w))"),
    ("iban", r"(?P<iban2>(?<!\w)[A-Z]{2}\d{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?(?!\w))"),
    ("ip", r"(?P<ip>(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\w|\.\d))"),
    ("ssn", r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"),
    ("phone", r"(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])|(?<![\w.-])(?=0(?: ?\d){8,11}(?!\d))0\d{1,4}(?: \d{2,4}){2,4}(?![\w.-]))"),
    ("phone", r"(?i:(?<!\w)(?:tel|telephone|phone|call|mobile|fax)(?: me| us)?(?: (?:at|on))?[.:]{0,2} )(?P<phone2>\d[\d ./-]{5,14}\d(?!\w))"),
    ("card", r"(?P<card>(?<![\w.])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\w))"),
    ("name", rf"(?P<name>(?<!\w)(?:(?:{'|'.join(map(re.escape, TITLES))}) {CAPITAL}(?: {CAPITAL})?|(?:{LISTED}) {CAPITAL}(?!\w)))"),
    ("name", rf"(?i:(?<!\w)(?:my name is|his name is|her name is|full name:|name:)) (?P<name2>{CAPITAL}(?: {CAPITAL}){{1,2}})"),
    ("name", rf"(?P<name3>[{HAN_FAMILY}][{HAN_GIVEN}]{{1,2}}|[{HAN_FAMILY}][一-鿿]{{1,2}}(?={HAN_TITLES}))"),
]
ENTITY = re.compile("|".join(p for _, p in PATTERNS))
HEX = re.compile(r"[0-9a-fA-F]+")
#: Without one of these a text holds no entity.
HINT = re.compile(rf"\d|@|[=:]|name is|[{HAN_FAMILY}]|" + "|".join(sorted({re.escape(x) for x in [*TITLES, *GENDER]})))


@lru_cache(maxsize=4096)
def alphabet(c: str) -> str:
    """The lower-case letters, or digits, among which a character is replaced; itself alone if it is neither."""
    if c.isdigit():
        if c.isascii():
            return "0123456789"
        zero = chr(ord(c) - unicodedata.digit(c, 0))
        return "".join(chr(ord(zero) + k) for k in range(10)) if unicodedata.category(c) == "Nd" else c
    if "a" <= c <= "z":
        return "abcdefghijklmnopqrstuvwxyz"
    if not c.isalpha():
        return c
    start = ord(c) & ~0x1F  # letters of the same kind close by: the same script
    out = "".join(x for x in map(chr, range(start, start + 32)) if unicodedata.category(x) == unicodedata.category(c) and x.lower() == x and len(x.upper()) == 1 and x.upper().lower() == x)
    return out if c in out else c


@lru_cache(maxsize=4096)
def sound(c: str) -> str:
    """Letters of a name that a letter may become: vowels for a vowel, others for another."""
    sets = (*VOWELS, *CONSONANTS, HAN_FAMILY, HAN_GIVEN)
    for v in sets:
        if c in v:
            return v
    other = "".join(x for x in alphabet(c) if not any(x in v for v in sets))
    return other if c in other else c


class Surrogates:
    def __init__(self, key: bytes) -> None:
        self.key = key
        self.replace = lru_cache(maxsize=1 << 16)(self._replace)

    def _mix(self, tweak: str, turn: int, x: int, n: int) -> int:
        data = f"{tweak}|{turn}|{x}".encode()
        wide, k = b"", 0
        while len(wide) * 8 < n.bit_length() + 64:
            wide += hmac.new(self.key, data + bytes([k]), hashlib.sha256).digest()
            k += 1
        return int.from_bytes(wide, "big") % n

    def _cipher(self, tweak: str, x: int, n: int, back: bool) -> int:
        """A keyed permutation of range(n): Feistel rounds over a * b >= n, walking until inside."""
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            u, v = divmod(x, b)
            turns = range(ROUNDS)
            for k in reversed(turns) if back else turns:
                if k % 2:
                    u = (u + (-1 if back else 1) * self._mix(tweak, k, v, a)) % a
                else:
                    v = (v + (-1 if back else 1) * self._mix(tweak, k, u, b)) % b
            x = u * b + v
            if x < n:
                return x

    def moved(self, tweak: str, x: int, n: int) -> int:
        """Another member of range(n), by a permutation without fixed points; 0 if there is only one."""
        return self._cipher(tweak, (self._cipher(tweak, x, n, False) + 1) % n, n, True) if n > 1 else 0

    def letters(self, kind: str, s: str, of=alphabet) -> str:
        """A string of the same format: digits for digits, letters of the same script and case for letters."""
        low = s.lower() if len(s.lower()) == len(s) else s
        sets = [of(c) for c in low]
        x, n = 0, 1
        for c, a in zip(low, sets, strict=True):
            x, n = x * len(a) + a.index(c), n * len(a)
        x = self.moved(f"{kind}|{'|'.join(a[0] + str(len(a)) for a in sets)}", x, n)
        out = []
        for c, a in zip(reversed(s), reversed(sets), strict=True):
            x, k = divmod(x, len(a))
            out.append(a[k].upper() if c.isupper() else a[k])
        return "".join(reversed(out))

    def given(self, name: str, gender: str) -> str:
        """A given name of the same gender and script; a title's gender counts more than the name's."""
        if name in GENDER:
            (script, g), names = GENDER[name]
            if gender in ("", g):
                return names[self.moved(f"name|{script}|{g}", names.index(name), len(names))]
            return self.invented(f"given|{gender}", name, 0)
        return self.invented("given", name, 1 if len(name) > 3 else 0)

    def family(self, name: str) -> str:
        """A name outside the lists of given names, with the ending of the family name."""
        if name in GENDER:
            return self.given(name, "")
        return self.invented("name", name, next((len(e) for e in sorted(ENDINGS, key=len, reverse=True) if name.endswith(e) and len(name) > len(e) + 1), 0))

    def invented(self, kind: str, name: str, kept: int) -> str:
        """A name of the same sounds whose last ``kept`` letters stay; no listed one."""
        stem, end = name[: len(name) - kept], name[len(name) - kept :]
        out = self.letters(f"{kind}|{end}", stem, sound)
        while out + end in GENDER:  # walks along the permutation's cycle, which leads back to a name outside
            out = self.letters(f"{kind}|{end}", out, sound)
        return out + end

    def _replace(self, kind: str, s: str) -> str:
        if kind == "ip":
            x = self.moved("ip", int.from_bytes(bytes(map(int, s.split("."))), "big"), 1 << 32)
            return ".".join(map(str, x.to_bytes(4, "big")))
        if kind == "card":  # keeps how far the last digit is from a valid check digit
            digits = [int(c) for c in s if c.isdigit()]
            body = self.letters(f"card{len(digits)}", "".join(map(str, digits[:-1])))
            last = (check(list(map(int, body))) + digits[-1] - check(digits[:-1])) % 10
            new = iter(body + str(last))
            return "".join(next(new) if c.isdigit() else c for c in s)
        if kind == "phone":  # keeps the country code
            code = re.match(r"\+\d{1,3}(?=\D)", s)
            at = code.end() if code else 0
            new = iter(self.letters("phone", "".join(c for c in s[at:] if c.isdigit())))
            return s[:at] + "".join(next(new) if c.isdigit() else c for c in s[at:])
        if kind == "email":  # one domain stays one domain; its last label is kept
            local, _, domain = s.rpartition("@")
            host, _, top = domain.rpartition(".")
            return f"{self.letters('local', local)}@{self.letters('host', host)}.{top}"
        if kind == "iban":  # keeps the country, and how far the check digits are from valid ones
            bare = s.replace(" ", "")
            body = self.letters("iban" + s[:2], bare[4:])
            given, right, new = int(bare[2:4]), iban_check(bare[:2], bare[4:]), iban_check(bare[:2], body)
            digits = f"{2 + (new - 2 + given - right) % 97:02d}" if 2 <= given <= 98 else bare[2:4]
            out = iter(bare[:2] + digits + body)
            return "".join(c if c == " " else next(out) for c in s)
        if kind == "name":
            return " ".join(self.words(s).values()) if len(set(s.split(" "))) == len(s.split(" ")) else " ".join(self.words(s)[w] for w in s.split(" "))
        if kind == "secret":  # hexadecimal ones stay hexadecimal, and no other one becomes so
            if HEX.fullmatch(s):
                n = 16 ** len(s)
                out = f"{self.moved(f'hex{len(s)}', int(s, 16), n):0{len(s)}x}"
                return out.upper() if s.upper() == s else out
            out = self.letters(kind, s)
            while HEX.fullmatch(out):
                out = self.letters(kind, out)
            return out
        return self.letters(kind, s)

    def words(self, name: str) -> dict[str, str]:
        """The words of a name and what they become; a title stays."""
        words = name.split(" ")
        out, title = {}, words[0] if words[0] in TITLES else None
        rest = words[1:] if title else words
        if title:
            out[title] = title
        if len(rest) == 1 and rest[0][0] in HAN_FAMILY:
            return out | {rest[0]: self.letters("han", rest[0], sound)}
        for k, w in enumerate(rest):
            out.setdefault(w, self.given(w, TITLES.get(title, "")) if k == 0 and len(rest) > 1 else self.family(w))
        return out

    def text(self, text: str) -> tuple[str, list[dict]]:
        """The text with surrogates, and the entities: type, span in the old text, surrogate."""
        spans, known = [], {}
        for m in ENTITY.finditer(text) if HINT.search(text) else ():
            kind = m.lastgroup.rstrip("0123456789")
            if m.lastgroup == "iban2" and not valid_iban(m[m.lastgroup]):
                continue
            spans.append((*m.span(m.lastgroup), kind, self.replace(kind, m[m.lastgroup])))
            if kind == "name":
                known |= {w: x for w, x in self.words(m[m.lastgroup]).items() if w not in TITLES and len(w) > 2 and w not in known}
        if known:  # later, or earlier, mentions by a part of the name
            taken = {k for a, b, _, _ in spans for k in range(a, b)}
            for m in re.finditer(rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, known), key=len, reverse=True))})(?!\w)", text):
                if m.start() not in taken:
                    spans.append((*m.span(), "name", known[m[0]]))
            spans.sort()
        out, at = [], 0
        for a, b, _, new in spans:
            out += [text[at:a], new]
            at = b
        found = [{"type": kind, "start": a, "end": b, "surrogate": new} for a, b, kind, new in spans]
        return "".join([*out, text[at:]]) if found else text, found


def iban_check(country: str, body: str) -> int:
    """The check digits of an account number, from 2 to 98."""
    return 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97


def valid_iban(s: str) -> bool:
    bare = s.replace(" ", "")
    return 15 <= len(bare) <= 34 and int(bare[2:4]) == iban_check(bare[:2], bare[4:])


def check(digits: list[int]) -> int:
    """The check digit of a card number without it."""
    total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits)))
    return -total % 10


_live: dict[bytes, Surrogates] = {}


def surrogates(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, entities`` of every whole text: surrogates in place, and where they are.

    One map without a shuffle.  Null and empty texts give an empty text without entities; repeated rows
    are replaced alike; an empty table gives an empty result.  An entity's upper and lower case forms
    have surrogates that differ in case only.
    """
    if len(key) < 16:
        raise ValueError("a key of at least 16 bytes is needed")
    kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = _live.get(key) or _live.setdefault(key, Surrogates(key))
        new = [s.text(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t for t, _ in new], pa.string()), pa.array([e for _, e in new], kind)], ["doc_id", "text", "entities"])

    return map_batches(id_text(docs, id_col, text_col), run, "doc_id long, text string, entities array<struct<type:string,start:int,end:int,surrogate:string>>")


def collisions(replaced: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``type, surrogate`` of the surrogates that are also entities of the corpus, by two distinct sets and one join.

    Given names always are, as their lists are short; of long formats hardly any is.  Entities and surrogates
    meet in small letters; null and empty texts have none; an empty table gives an empty result.
    """
    kind = "type string, entity string, surrogate string"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [(e["type"], t[e["start"] : e["end"]].lower(), e["surrogate"].lower()) for t, es in zip(batch.column("old").to_pylist(), batch.column("entities").to_pylist(), strict=True) for e in es or ()]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in range(3)], ["type", "entity", "surrogate"])

    old = id_text(docs, id_col, text_col).withColumnRenamed("text", "old")
    found = map_batches(old.join(replaced.select("doc_id", "entities").where("size(entities) > 0"), "doc_id"), run, kind)
    return found.select("type", "surrogate").distinct().join(found.select("type", found["entity"].alias("surrogate")).distinct(), ["type", "surrogate"])

"""PII: surrogate generation.

Detected entities get keyed replacements of the same kind, script and format: digits for digits, letters for letters of
the same case, an address of the same kind of network, a card number of the same issuer and a bank account of the same
country whose check digits are right where the original's are, a listed given name of the same gender and script. A given
name that isn't listed gets letters of its own kinds instead: its gender may be told by a title in one text and not in
the next, and one person must have one surrogate; titles stay. The mapping is
a keyed permutation of all strings of one format (a Feistel network, walked until it stays in the format's range), so
different originals stay different, and one original gets one surrogate in every text and on every executor without a
lookup. Given names come from short lists,
where two may meet; a collision check over all distinct entities of the corpus finds those and keys them anew. One that
meets others ``LIST_TRIES`` times gets a permutation of its own letters with an ending that no listed name has, which is
distinct by construction, so the check ends however many given names share a surname.

A name is found by its title, with up to three capitalised words after it, or by a listed given name before a
capitalised word; further whole-word mentions of its given name and surname in the same text, written as there or in
capitals, get the same surrogates, also those before it. Not detected: other names that no title introduces anywhere in
the text, initials, other scripts than Latin (with accents, to U+017F) and Cyrillic, internationalised domains, phones without separators or a leading plus, IPv6 addresses without a decimal digit, postal
addresses, and dates.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import OWN, written

#: Up to so many re-keyed entities, they are broadcast; beyond, they are joined to the texts that hold them.
BROADCAST_ENTITIES = 50_000

#: Given names by script and gender, in natural order.
GIVEN = {
    ("latin", "f"): "Alice Anna Bella Clara Diana Elena Emma Eva Flora Grace Hanna Ida Jane Julia Laura Lea Maria Mia Nina Nora Olga Paula Rita Rosa Sara Sofia Tina Vera".split(),
    ("latin", "m"): "Adam Albert Anton Bruno Carl David Emil Eric Felix Franz Hugo Ivan Jacob John Karl Leo Louis Lucas Marc Max Nils Oscar Otto Paul Peter Simon Thomas Victor".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга".split(),
    ("cyrillic", "m"): "Антон Борис Иван Игорь Лев Олег Павел Роман".split(),
}
#: So often a given name is drawn from the lists; then its letters are permuted.
LIST_TRIES = 8
#: Endings that no listed name has.
ENDINGS = {"latin": "en", "cyrillic": "ин"}
TITLES = ("mr", "herr", "monsieur", "señor", "sr", "mrs", "ms", "miss", "frau", "madame", "mme", "señora", "sra", "dr", "prof")
#: First and last address of the IPv4 networks that aren't public.
NETWORKS = [(int(n[0]), int(n[-1])) for n in map(ipaddress.ip_network, ("10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4", "240.0.0.0/4"))]
LETTERS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщъьё")
ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"
#: Latin Extended-A: letters whose capital is one letter too.
EXTENDED = "".join(c for c in map(chr, range(0x100, 0x180)) if c.islower() and c.upper() != c and len(c.upper()) == 1 and c.upper().lower() == c)
_UP = "A-ZÀ-ÖØ-ÞА-ЯЁ" + EXTENDED.upper()
_LOW = "a-zß-öø-ÿа-яё" + EXTENDED
NAME_LETTERS = (*LETTERS, ACCENTED, EXTENDED)
#: A capitalised word of a name.
_WORD = rf"(?:[OD]['’]|Mc)?[{_UP}][{_LOW}'’-]+"

_HEX = "[0-9A-Fa-f]{1,4}"
_IPV6 = "|".join([rf"(?:{_HEX}:){{7}}{_HEX}", *(rf"(?:{_HEX}:){{{n}}}(?::{_HEX}){{1,{7 - n}}}" for n in range(6, 0, -1)), rf":(?::{_HEX}){{1,7}}", rf"(?:{_HEX}:){{1,7}}:"])

PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9-])",
    "secret": r"(?:(?<=(?i:password)=)|(?<=(?i:passwd)=)|(?<=(?i:secret)=)|(?<=(?i:token)=)|(?<=(?i:key)=))[0-9A-Za-z_+/=-]{6,}|(?:(?<=(?i:password): )|(?<=(?i:passwd): )|(?<=(?i:secret): )|(?<=(?i:token): )|(?<=(?i:key): ))(?=[A-Za-z_+/=-]*[0-9])[0-9A-Za-z_+/=-]{6,}|(?<![0-9A-Za-z])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[pous]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,})(?![0-9A-Za-z])|(?<=[=:] [\"'])[0-9A-Za-z_+/=-]{16,}(?=[\"'])|(?<=[=:][\"'])[0-9A-Za-z_+/=-]{16,}(?=[\"'])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)" rf"|(?<![\w:.])(?=[0-9A-Fa-f]{{0,4}}:)(?=[A-Fa-f:]*[0-9])(?:{_IPV6})(?![\w:]|\.\d)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\w.])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w]|\.\d)|(?<![\w.])\d{4}[ -]\d{6}[ -]\d{5}(?![\w]|\.\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w+])(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "name": rf"(?<!\w)(?:(?i:{'|'.join(TITLES)}))\.? (?:{_WORD}(?: (?=[{_UP}])|(?![{_LOW}{_UP}]))){{1,3}}",
    "person": rf"(?<!\w)(?=[{_UP}])(?:{'|'.join(n for own in GIVEN.values() for n in own)}) (?:[OD]['’]|Mc)?[{_UP}][{_LOW}]+(?!\w)",
}
ANY = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in PATTERNS.items()))
#: What follows a name and isn't of it: a genitive, a quote or dash, a space.
AFTER = re.compile(r"(?:['’]s)?['’ -]*$")
#: What a text must hold to have any entity.
MAYBE = re.compile(rf"[0-9@=]|: ?[\"']|gh[pous]_|sk-|AKIA|(?<!\w)(?i:{'|'.join(TITLES)})\.? [{_UP}]|" + PATTERNS["person"])

Entity = tuple[str, str]  # kind and canonical value


class Permutation:
    """A keyed permutation of 0..n-1 without fixed points (n > 1)."""

    def __init__(self, n: int, key: bytes, tweak: str):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = [hashlib.blake2b(f"{tweak}/{i}".encode(), key=key, digest_size=32).digest() for i in range(8)]
        self.shift = 1 + int.from_bytes(self.keys[0], "big") % max(1, n - 1)

    def _round(self, i: int, x: int) -> int:
        size = -(-self.half // 8)
        if size + 8 <= 64:
            digest = hashlib.blake2b(x.to_bytes(size, "big"), key=self.keys[i], digest_size=size + 8).digest()
        else:  # as wide as the half, however long the value is
            digest = hashlib.shake_256(self.keys[i] + x.to_bytes(size, "big")).digest(size + 8)
        return int.from_bytes(digest, "big") & ((1 << self.half) - 1)

    def _walk(self, x: int, back: bool) -> int:
        mask = (1 << self.half) - 1
        while True:
            left, right = x >> self.half, x & mask
            for i in reversed(range(8)) if back else range(8):
                if back:
                    left, right = right ^ self._round(i, left), left
                else:
                    left, right = right, left ^ self._round(i, right)
            x = left << self.half | right
            if x < self.n:
                return x

    def __call__(self, x: int) -> int:
        return x if self.n < 2 else self._walk((self._walk(x, False) + self.shift) % self.n, True)


@lru_cache(maxsize=4096)
def permutation(n: int, key: bytes, tweak: str) -> Permutation:
    return Permutation(n, key, tweak)


def like(value: str, key: bytes, tweak: str, accept: Callable[[str], bool] = lambda s: True, alphabets: tuple[str, ...] = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюяё")) -> str:
    """Another string of the same format: characters of an alphabet stay in it, others stay as they are.

    ``accept`` must hold for ``value``; the permutation is walked until it holds again, which keeps it one to one.
    """
    sets = [next((a for a in alphabets if c in a), None) for c in value]
    shape = "".join("?" + str(alphabets.index(a)) if a else c for a, c in zip(sets, value, strict=True))
    n = 1
    for a in sets:
        n *= len(a) if a else 1
    if n == 1:
        return value
    x = 0
    for a, c in zip(sets, value, strict=True):
        if a:
            x = x * len(a) + a.index(c)
    p = permutation(n, key, f"{tweak}|{shape}")
    while True:
        x, rest, out = p(x), None, []
        rest = x
        for a, c in zip(reversed(sets), reversed(value), strict=True):
            if a:
                rest, d = divmod(rest, len(a))
                c = a[d]
            out.append(c)
        made = "".join(reversed(out))
        if accept(made):
            return made


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 * (d > 4))
    return total % 10 == 0


def iban_check(country: str, account: str) -> str:
    """The check digits that make the number leave 1 when divided by 97."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def canonical(kind: str, found: str) -> str:
    """What makes two mentions the same entity: format and case don't."""
    if kind in ("card", "phone", "ssn"):
        return "".join(c for c in found if c.isdigit())
    if kind == "iban":
        return found.replace(" ", "")
    if kind == "email" or kind == "secret" and re.fullmatch("[0-9A-F]+|[0-9a-f]+", found):
        return found.lower()
    if kind == "ip" and ":" in found:
        return ipaddress.ip_address(found).exploded
    if kind in ("name", "person"):
        rest = found.split()[kind == "name" :]  # a title isn't of the person: Mr. and Dr. of one name are one
        given = rest[0].lower() if len(rest) > 1 else ""
        return f"{given}|{' '.join(rest[bool(given) :]).lower()}"
    return found


def entity_of(kind: str, found: str) -> Entity:
    return "name" if kind == "person" else kind, canonical(kind, found)


def given_name(given: str, key: bytes, attempt: int) -> str:
    """A given name of the same gender and script; for one that isn't listed, and after ``LIST_TRIES`` attempts, one that no other given name gets."""
    script = "cyrillic" if re.search("[а-яё]", given) else "latin"
    gender = next((g for (s, g), names in GIVEN.items() if s == script and given.title() in names), None)
    if gender is None or attempt >= LIST_TRIES:
        return like(given, key, "given", alphabets=NAME_LETTERS) + ENDINGS[script]
    names = sorted(set(GIVEN[(script, gender)]) - {given.title()})
    digest = hashlib.blake2b(f"given|{script}|{gender}|{given}|{attempt}".encode(), key=key, digest_size=8).digest()
    return names[int.from_bytes(digest, "big") % len(names)].lower()


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """The canonical surrogate of a canonical value."""
    tweak = f"{kind}/{attempt}"
    if kind == "email":
        local, _, domain = value.partition("@")
        host, _, top = domain.rpartition(".")
        return f"{like(local, key, tweak)}@{like(host, key, 'domain')}.{top}"
    if kind == "ip" and ":" in value:
        return like(value, key, tweak, alphabets=("0123456789abcdef",))
    if kind == "ip":
        n = 0
        for octet in value.split("."):
            n = n * 256 + int(octet)
        first, last = next((x for x in NETWORKS if x[0] <= n <= x[1]), (0, (1 << 32) - 1))
        move, special = permutation(last - first + 1, key, f"{tweak}/{first}"), first > 0
        n = first + move(n - first)
        while not special and any(a <= n <= b for a, b in NETWORKS):
            n = move(n)
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card":
        valid = luhn(value)
        head = value[:2]
        return head + like(value[2:], key, f"{tweak}/{head}/{valid}", lambda s: luhn(head + s) == valid)
    if kind == "phone":
        head = min(1 if value[0] == "1" else 2, len(value) - 7) if len(value) > 10 else 0
        return value[:head] + like(value[head:], key, f"{tweak}/{value[:head]}")
    if kind == "iban":
        country, letters = value[:2], ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        if value[2:4] == iban_check(country, value[4:]):
            account = like(value[4:], key, f"{tweak}/{country}", alphabets=letters)
            return country + iban_check(country, account) + account
        return country + like(value[2:], key, f"{tweak}/{country}/wrong", lambda s: s[:2] != iban_check(country, s[2:]), letters)
    if kind == "secret":
        if re.fullmatch("[0-9a-f]+", value):
            return like(value, key, tweak, alphabets=("0123456789abcdef",))
        head = re.match("AKIA|gh[pous]_|sk-|", value)[0]
        return head + like(value[len(head) :], key, f"{tweak}/{head}", alphabets=("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    if kind in ("name", "person"):
        given, surname = value.split("|")
        return f"{given and given_name(given, key, attempt)}|{like(surname, key, 'surname', alphabets=NAME_LETTERS)}"
    return like(value, key, tweak)


def rendered(kind: str, found: str, made: str) -> str:
    """The canonical surrogate in the format and case of the mention."""
    if kind in ("card", "phone", "ssn", "iban"):
        left = iter(made)
        return "".join(next(left) if c.isalnum() else c for c in found)
    if kind == "ip" and ":" in made:
        short = str(ipaddress.ip_address(made))
        return short.upper() if found == found.upper() != found.lower() else short
    if kind in ("email", "secret") and found == found.upper() and made == made.lower():
        return made.upper() if any(c.isalpha() for c in found) else made
    if kind == "email":
        return "".join(m.upper() if c.isupper() else m for c, m in zip(found, made, strict=True))
    if kind in ("name", "person"):
        title = found.split()[:1] if kind == "name" else []
        given, surname = made.split("|")
        return " ".join([*title, *([given.title()] if given else []), *[s.title() for s in surname.split()]])
    return made


def mentions(text: str | None) -> list[tuple[int, int, str]]:
    """Start, end and kind of each entity of a text, in order and without overlap."""
    if not text or not MAYBE.search(text):
        return []
    return [(m.start(), m.start() + len(AFTER.sub("", m[0]) if m.lastgroup in ("name", "person") else m[0].rstrip(" ")), m.lastgroup) for m in ANY.finditer(text)]


def further(found: str, made: str, title: bool) -> dict[str, str]:
    """What a found name is called by elsewhere: in full without its title, and each word of it alone."""
    own, new = found.split()[title:], made.split()[title:]
    pairs = [(" ".join(own), " ".join(new)), *zip(own, new, strict=True)]
    return {a: b for x, y in pairs for a, b in ((x, y), (x.upper(), y.upper()))}


def replaced(text: str | None, key: bytes, attempts: dict[Entity, int]) -> tuple[str | None, int]:
    out, at, names = [], 0, {}
    for start, end, kind in mentions(text):
        entity = entity_of(kind, text[start:end])
        made = rendered(kind, text[start:end], surrogate(*entity, key, attempts.get(entity, 0)))
        if kind in ("name", "person"):
            names = further(text[start:end], made, kind == "name") | names
        out += [text[at:start], made]
        at = end
    if not out:
        return text, 0
    out.append(text[at:])
    n = len(out) // 2
    if names:
        again = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})(?!\w)")
        for i in range(0, len(out), 2):
            out[i], more = again.subn(lambda m: names[m[0]], out[i])
            n += more
    return "".join(out), n


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The distinct ``kind`` and ``value`` of all texts, summed up before they are shuffled."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = {entity_of(kind, t[start:end]) for t in b[text_col] for start, end, kind in mentions(t)}
            yield pd.DataFrame(sorted(own), columns=["kind", "value"], dtype="object")

    return docs.select(text_col).mapInPandas(found, "kind string, value string").distinct()


def collisions(found: DataFrame, key: bytes) -> DataFrame:
    """``kind``, ``value``, ``attempt`` of the entities whose first surrogate another entity has; the smallest value keeps it."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(surrogate=[surrogate(k, v, key, a) for k, v, a in zip(b.kind, b.value, b.attempt, strict=True)])

    schema = "kind string, value string, attempt int, surrogate string"
    state = written(found.withColumn("attempt", F.lit(0)).mapInPandas(made, schema), "pii-surrogates")
    order = Window.partitionBy("kind", "surrogate").orderBy("attempt", "value")
    while True:
        ranked = state.withColumn("r", F.row_number().over(order))
        if ranked.filter("r > 1").isEmpty():
            return state.filter("attempt > 0").select("kind", "value", "attempt")
        again = ranked.filter("r > 1").select("kind", "value", (F.col("attempt") + 1).cast("int").alias("attempt")).mapInPandas(made, schema)
        state = written(ranked.filter("r = 1").select(*state.columns).unionByName(again), "pii-surrogates")


def pseudonymize(docs: DataFrame, key: bytes, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with every detected entity replaced in ``text_col``; ``count_col`` gets the number of replacements.

    Null texts stay null and empty ones empty. Texts without entities stay as they are, byte for byte. Repeated rows get
    equal texts. Other columns stay, one named ``count_col`` is replaced.
    """
    rekeyed = written(collisions(entities(docs, text_col), key), "pii-rekeyed")
    n = rekeyed.count()
    small = {(r.kind, r.value): r.attempt for r in rekeyed.collect()} if n <= BROADCAST_ENTITIES else {}
    shared = docs.sparkSession.sparkContext.broadcast(small)

    def swap(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, own in batches:
            done = [replaced(t, key, shared.value if o is None else {(x["kind"], x["value"]): x["attempt"] for x in o}) for t, o in zip(texts, own, strict=True)]
            yield pd.DataFrame(done, columns=["text", "n"]).astype({"text": "object", "n": "int64"})

    attempts = F.expr("cast(null as array<struct<kind:string,value:string,attempt:int>>)")
    if n > BROADCAST_ENTITIES:

        def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = {(h, *entity_of(kind, t[start:end])) for h, t in zip(b.h, b.t, strict=True) for start, end, kind in mentions(t)}
                yield pd.DataFrame(sorted(rows), columns=["h", "kind", "value"])

        texts = docs.select(F.sha2(text_col, 256).alias("h"), F.col(text_col).alias("t")).filter("h is not null")
        by_text = texts.mapInPandas(held, "h string, kind string, value string").distinct().join(rekeyed, ["kind", "value"]).groupBy(F.col("h").alias(f"{OWN}h")).agg(F.collect_list(F.struct("kind", "value", "attempt")).alias(f"{OWN}e"))
        docs = docs.join(by_text, F.sha2(text_col, 256) == F.col(f"{OWN}h"), "left").drop(f"{OWN}h")
        attempts = F.col(f"{OWN}e")
    out = docs.withColumn(f"{OWN}r", F.pandas_udf(swap, "text string, n long")(F.col(text_col), attempts))
    out = out.withColumn(text_col, F.col(f"{OWN}r.text"))
    return (out.withColumn(count_col, F.col(f"{OWN}r.n")) if count_col else out).drop(f"{OWN}r", f"{OWN}e")

"""Personal data replaced by keyed surrogates of the same type and format."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.common import bound_batches

#: Given names by script and gender.
GIVEN_NAMES = {
    ("latin", "f"): (
        "Anna Maria Emma Julia Laura Sarah Marta Elena Claire Sophie Lucia Carmen Ingrid Petra Helen Alice Nora Irene Paula Diana "
        "Clara Eva Greta Hanna Ida Johanna Katrin Lena Martha Monica Olivia Pilar Rosa Ruth Silvia Susanne Teresa Ursula Valerie Vera"
    ).split(),
    ("latin", "m"): (
        "John James Peter Paul David Thomas Martin Daniel Jean Pierre Carlos Miguel Hans Karl Robert Simon Victor Oscar Hugo Adam "
        "Albert Andreas Antonio Bernard Bruno Diego Erik Felix Francisco George Henry Jakob Jorge Klaus Louis Manuel Michael Otto Philip Stefan"
    ).split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана Юлия Вера Екатерина Людмила Галина Надежда Любовь".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил Павел Олег Владимир Виктор Юрий Антон Максим".split(),
}
#: What introduces a name.
TITLES = "Mrs Mr Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señora Señor Sra Sr Doña Don".split()

_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω][a-zß-öø-ÿа-яёα-ωά-ώ]+(?:-[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)?"
#: Scripts without capitals: a name of them is what follows "name:" up to the next other sign.
_UNCASED = r"[\u3040-\u30FF\u3400-\u9FFF\uAC00-\uD7A3\u0590-\u06FF\u0900-\u097F\u0E00-\u0E7F]+"
_TITLED = re.compile(
    rf"\b(?:{'|'.join(TITLES)})\b\.?\x20({_NAME}(?:\x20{_NAME})?)|\b(?:[Mm]y name is|[Nn]ame:)\x20(?:({_NAME}(?:\x20{_NAME})?)|({_UNCASED}(?:[\x20·]{_UNCASED})?))"
)
_WORD = re.compile(r"\w+(?:-\w+)*")
_PATTERNS = {
    "email": re.compile(r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)"),
    "ip": re.compile(r"(?<![\w.-])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w-]|\.\d)"),
    "phone": re.compile(r"(?<![\w+(.-])(?:\+?\d{1,3}[\x20.-]?)?\(\d{2,4}\)[\x20.-]?\d{2,4}[\x20.-]?\d{3,4}(?![\w-])|(?<![\w+(.-])\+\d{1,3}(?:[\x20.-]?\d{2,4}){2,5}(?![\w-])|(?<![\w+(.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "card": re.compile(r"(?<![\w.-])\d(?:[\x20-]?\d){12,18}(?![\w-])"),
}
_DIGIT = re.compile(r"\d")

#: What may stand for what: digits, vowels, consonants and marked letters of
#: either case, and the letters of other scripts among themselves. Common
#: Chinese characters of names stay among themselves, as do the others.
_COMMON_HAN = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许邓冯韩曹曾彭伟芳娜敏静丽强磊军洋勇艳杰娟涛明超兰霞平刚桂英华文玉红建国志春雷"


def _between(*spans: tuple[int, int], leave: str = "") -> str:
    return "".join(c for a, b in spans for c in map(chr, range(a, b + 1)) if c.isalpha() and c not in leave)


_CLASSES = [
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "àáâãäåæèéêëìíîïòóôõöøùúûü", "ÀÁÂÃÄÅÆÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜ", "çðñýþÿß", "ÇÐÑÝÞ",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
    _COMMON_HAN, _between((0x3400, 0x9FFF), leave=_COMMON_HAN), _between((0x3041, 0x3096)), _between((0x30A1, 0x30FA)),
    _between((0xAC00, 0xD7A3)), _between((0x05D0, 0x05EA)), _between((0x0620, 0x064A), (0x0671, 0x06D3)), _between((0x0904, 0x0939)), _between((0x0E01, 0x0E30)),
]
_CLASS_OF = {c: k for k, cs in enumerate(_CLASSES) for c in cs}
_PLACE_OF = {c: i for cs in _CLASSES for i, c in enumerate(cs)}
ROUNDS = 10


class Surrogates:
    """A keyed bijection of entities that keeps type, format and script.

    Letters stay letters of their kind, digits digits, and everything else in
    place, so that distinct entities of one format keep distinct surrogates,
    and equal ones the same surrogate wherever they occur. No entity is its own
    surrogate where its format allows another. Each surrogate is inverted at
    once to prove it; one that could not be would be replaced letter by letter
    within its format, a bijection for any text.
    """

    def __init__(self, key: str):
        self.key = hashlib.sha256(key.encode()).digest()
        self.names = {}
        for group, names in GIVEN_NAMES.items():
            ring = sorted(names, key=lambda n: self._number(f"ring{group}", n, 1 << 64))
            self.names |= {a: b for a, b in zip(ring, ring[1:] + ring[:1], strict=True)}
        self.named = {b: a for a, b in self.names.items()}
        self.of = lru_cache(65536)(self._of)

    def _number(self, tweak: str, value: object, below: int) -> int:
        raw = hashlib.blake2b(f"{tweak}|{value}".encode(), key=self.key, digest_size=32).digest()
        return int.from_bytes(raw, "big") % below

    def _turn(self, tweak: str, a: int, b: int, sizes: tuple[int, int], back: bool) -> tuple[int, int]:
        """Feistel rounds on a pair of numbers below `sizes`."""
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if r % 2:
                b = (b + sign * self._number(f"{tweak}{r}", a, sizes[1])) % sizes[1]
            else:
                a = (a + sign * self._number(f"{tweak}{r}", b, sizes[0])) % sizes[0]
        return a, b

    def _moved(self, tweak: str, a: int, b: int, sizes: tuple[int, int], back: bool) -> tuple[int, int]:
        """A keyed bijection on pairs below `sizes` that leaves no pair as it
        is, if there are two: one step on the cycle that the rounds lay out."""
        a, b = self._turn(tweak, a, b, sizes, False)
        step = (a * sizes[1] + b + (-1 if back else 1)) % (sizes[0] * sizes[1])
        return self._turn(tweak, *divmod(step, sizes[1]), sizes, True)

    def _letters(self, kind: str, text: str, free: list[bool], back: bool) -> str:
        """Permutes the free places of `text` within its format."""
        at = [i for i, c in enumerate(text) if free[i] and c in _CLASS_OF]
        if not at:
            return text
        classes = [_CLASSES[_CLASS_OF[text[i]]] for i in at]
        half = (len(at) + 1) // 2
        shape = "".join("\1" + chr(2 + _CLASS_OF[c]) if i in set(at) else c for i, c in enumerate(text))

        def pack(places: range) -> tuple[int, int]:
            value, size = 0, 1
            for j in places:
                value = value * len(classes[j]) + _PLACE_OF[text[at[j]]]
                size *= len(classes[j])
            return value, size

        (a, size_a), (b, size_b) = pack(range(half)), pack(range(half, len(at)))
        a, b = self._moved(f"{kind}|{shape}|", a, b, (size_a, size_b), back)
        out = list(text)
        for value, places in ((a, range(half)), (b, range(half, len(at)))):
            for j in reversed(places):
                value, digit = divmod(value, len(classes[j]))
                out[at[j]] = classes[j][digit]
        return "".join(out)

    def _apply(self, kind: str, text: str, back: bool = False) -> str:
        if kind == "ip":
            o = [int(x) for x in text.split(".")]
            # Hosts and other addresses (0 and 224 to 255) each stay of their kind.
            first = range(1, 224) if 1 <= o[0] <= 223 else (0, *range(224, 256))
            a, b = self._moved(f"ip{len(first)}|", first.index(o[0]) * 256 + o[1], o[2] * 256 + o[3], (len(first) * 256, 65536), back)
            return f"{first[a // 256]}.{a % 256}.{b // 256}.{b % 256}"
        if kind == "name":
            return " ".join(self._name(w, back) for w in text.split(" "))
        if kind == "email":
            keep = len(text) - text[::-1].index(".") - 1
            return self._letters(kind, text, [i < keep for i in range(len(text))], back)
        if kind == "card":
            digits = [i for i, c in enumerate(text) if c.isdigit()]
            off = (int(text[digits[-1]]) - _luhn([text[i] for i in digits[:-1]])) % 10
            blank = text[: digits[-1]] + "0" + text[digits[-1] + 1 :]
            new = self._letters(kind, blank, [i != digits[0] and i != digits[-1] for i in range(len(text))], back)
            check = (_luhn([new[i] for i in digits[:-1]]) + off) % 10
            return new[: digits[-1]] + str(check) + new[digits[-1] + 1 :]
        if kind == "iban":
            new = self._letters(kind, f"{text[:2]}00{text[4:]}", [i >= 4 for i in range(len(text))], back)
            return new[:2] + f"{98 - _mod97(new[:2] + '00' + new[4:]):02d}" + new[4:]
        if kind == "phone":
            start = re.match(r"\+?\d{1,3}(?=[\x20.(-])", text)
            keep = start.end() if start and text[0] == "+" else 0
            return self._letters(kind, text, [i >= keep for i in range(len(text))], back)
        return self._letters(kind, text, [True] * len(text), back)

    def _name(self, word: str, back: bool) -> str:
        """Listed names move within their gender and script; the last letter of
        others stays, as it often marks gender, unless it is the only one; no
        listed name results."""
        listed = self.named if back else self.names
        if word in listed:
            return listed[word]
        free = [i < len(word) - 1 or len(word) == 1 for i in range(len(word))]
        out = self._letters("name", word, free, back)
        while out in listed:
            out = self._letters("name", out, free, back)
        return out

    def _of(self, kind: str, text: str) -> str:
        try:
            out = self._apply(kind, text)
            if self._apply(kind, out, back=True) == text:
                return out
        except (ValueError, IndexError):  # not of its kind's format
            pass
        return self._letters(f"{kind}|plain", text, [True] * len(text), False)


def _luhn(digits: list[str]) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _mod97(iban: str) -> int:
    flat = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97


def _is_iban(text: str) -> bool:
    """Length and check digits; those of an issued number are 02 to 98."""
    return 15 <= len(text.replace(" ", "")) <= 34 and 2 <= int(text[2:4]) <= 98 and _mod97(text) == 1


def _mentions(text: str, names: set[str]) -> Iterator[tuple[int, int]]:
    """Where words of introduced names stand again; neighbouring ones are one name."""
    words = {w for name in names for w in _WORD.findall(name)}
    start = end = -1
    for m in _WORD.finditer(text):
        if m[0] in words:
            if start >= 0 and text[end : m.start()] == " ":
                end = m.end()
                continue
            if start >= 0:
                yield start, end
            start, end = m.span()
    if start >= 0:
        yield start, end


def find_entities(text: str | None) -> list[tuple[str, int, int]]:
    """(type, start, end) of personal data, left to right without overlap; of
    overlapping finds the earlier start wins, then the longer, then the order
    email, iban, ip, phone, ssn, card, name. A name is what a title or "name:"
    introduces, and every other mention of its words in the text. Positions
    count code points; null and empty texts have none."""
    if not text:
        return []
    found: list[tuple[int, int, int, str]] = []
    names = list(_PATTERNS)
    digits = bool(_DIGIT.search(text))
    for rank, (kind, pattern) in enumerate(_PATTERNS.items()):
        if "@" in text if kind == "email" else digits:
            for m in pattern.finditer(text):
                if kind != "iban" or _is_iban(m[0]):
                    found.append((m.start(), -m.end(), rank, kind))
    called: set[str] = set()
    for m in _TITLED.finditer(text):
        called.add(m[m.lastindex])
        found.append((m.start(m.lastindex), -m.end(m.lastindex), len(names), "name"))
    if called:
        found += [(a, -b, len(names), "name") for a, b in _mentions(text, called)]
    out: list[tuple[str, int, int]] = []
    reach = 0
    for start, end, _, kind in sorted(found):
        if start >= reach:
            out.append((kind, start, -end))
            reach = -end
    return out


def with_surrogates(text: str | None, surrogates: Surrogates) -> tuple[str | None, list[tuple[str, int, int, str]]]:
    """The text with its entities replaced, and (type, start, end, surrogate)
    with places in the original."""
    entities = [(kind, a, b, surrogates.of(kind, text[a:b])) for kind, a, b in find_entities(text)]
    if not entities:
        return text, []
    parts, last = [], 0
    for _, a, b, new in entities:
        parts += [text[last:a], new]
        last = b
    return "".join([*parts, text[last:]]), entities


def pseudonymize(docs: DataFrame, *, key: str) -> DataFrame:
    """doc_id, text (with surrogates) and entities (type, start, end,
    surrogate) for every row of `docs`. The same key gives the same surrogates
    in every document and run. Null texts stay null, texts without entities
    (empty ones too) stay as they are; repeated rows each get a row; no rows
    give no rows; texts are read whole; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        fields = ("type", "start", "end", "surrogate")
        kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("surrogate", pa.string())]))
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                done = [with_surrogates(t, surrogates) for t in part.column(1).to_pylist()]
                spans = [[dict(zip(fields, e, strict=True)) for e in es] for _, es in done]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t for t, _ in done], pa.string()), pa.array(spans, kind)], ["doc_id", "text", "entities"])

    bound_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, entities array<struct<type:string,start:long,end:long,surrogate:string>>")

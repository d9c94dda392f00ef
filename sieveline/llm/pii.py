"""Format-preserving Feistel pseudonyms for validated numbers, dates and mail addresses."""

import datetime
import hashlib
import re
import secrets
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, replace_columns

#: Production parameters. The key is a secret of the deployment, in the session's configuration under KEY_CONF; equal
#: keys give equal pseudonyms. Without one a key is drawn that ends with the query.
KEY_CONF = "spark.sieveline.pseudonym.key"
ROUNDS = 8
#: Mail names of at most so many letters and digits may become any of them, as few have their very classes.
SHORT_NAME = 3
DAY0, DAYS = datetime.date(1900, 1, 1).toordinal(), 73049  # 1900-01-01 to 2099-12-31

#: Candidates in order of precedence. A candidate counts only if its validator accepts it.
PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])\w[\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<aws>(?<!\w)AKIA[A-Z0-9]{12,20}(?!\w))"
    r"|(?P<secret>(?<=[\s=:\"'])(?<!\w)[0-9a-f]{16,64}(?!\w))"
    r"|(?P<date>(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?![\w]|[./-]\d))"
    r"|(?P<ip>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w]|-\d))"
)
CONTEXT = re.compile(r"(?:password|passwd|secret|token|api[_-]?key)\W{1,5}$", re.IGNORECASE)

RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_pii", T.IntegerType()), T.StructField("kinds", T.ArrayType(T.StringType()))])


class Feistel:
    """A keyed permutation of [0, n): balanced Feistel rounds over the next even number of bits, walked along its
    cycle until the value is back inside."""

    def __init__(self, key: str | bytes, n: int, tweak: str = "", rounds: int = ROUNDS):
        self.n, self.half = n, max(1, ((n - 1).bit_length() + 1) // 2)
        self.mask, self.rounds = (1 << self.half) - 1, rounds
        secret = key.encode() if isinstance(key, str) else key
        self.key = hashlib.blake2b(f"{tweak}|{n}".encode(), key=hashlib.blake2b(secret, digest_size=32).digest(), digest_size=32).digest()

    def _f(self, r: int, x: int) -> int:
        size = (self.half + 7) // 8
        return int.from_bytes(hashlib.blake2b(x.to_bytes(size, "big") + bytes([r]), key=self.key, digest_size=max(size, 8)).digest(), "big") & self.mask

    def _once(self, x: int) -> int:
        a, b = x >> self.half, x & self.mask
        for r in range(self.rounds):
            a, b = b, a ^ self._f(r, b)
        return (a << self.half) | b

    def _back(self, x: int) -> int:
        a, b = x >> self.half, x & self.mask
        for r in reversed(range(self.rounds)):
            a, b = b ^ self._f(r, a), a
        return (a << self.half) | b

    def __call__(self, x: int) -> int:
        if self.n < 2:
            return x
        x = self._once(x)
        while x >= self.n:
            x = self._once(x)
        return x

    def inverse(self, x: int) -> int:
        if self.n < 2:
            return x
        x = self._back(x)
        while x >= self.n:
            x = self._back(x)
        return x


class Derangement:
    """A keyed permutation of [0, n) without a fixed point (n > 1): into Feistel order, a keyed step around the ring, and
    back."""

    def __init__(self, key: str | bytes, n: int, tweak: str = ""):
        self.n, self.feistel = n, Feistel(key, n, tweak)
        self.step = 1 + int.from_bytes(hashlib.blake2b(b"step", key=self.feistel.key, digest_size=32).digest(), "big") % max(1, n - 1)

    def __call__(self, x: int) -> int:
        return self.feistel.inverse((self.feistel(x) + self.step) % self.n) if self.n > 1 else x

    def inverse(self, x: int) -> int:
        return self.feistel.inverse((self.feistel(x) - self.step) % self.n) if self.n > 1 else x


@lru_cache(maxsize=4096)
def alphabet(c: str) -> str:
    """The characters that c may become: ASCII letters of its case, digits, else letters or digits of its category in
    its 256 code points (in its plane, if it is alone there); '' where it stays."""
    if c in "0123456789":
        return "0123456789"
    if c.isascii():
        return "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() else ""
    if not c.isalnum():
        return ""
    kind = unicodedata.category(c)
    for size in (256, 65536):
        first = ord(c) // size * size
        same = "".join(x for x in map(chr, range(max(128, first), first + size)) if unicodedata.category(x) == kind and x.isalnum())
        if len(same) > 1:
            return same
    return ""


ALPHANUMERIC = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def luhn_digit(payload: str) -> str:
    s = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(payload))))
    return str(-s % 10)


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _into(template: str, digits: str) -> str:
    """template with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in template)


class Pseudonymiser:
    """replace() gives the pseudonym of a valid value, never the value itself, else None. Values that differ in layout
    only have pseudonyms that differ in layout only. Without a key one is drawn."""

    def __init__(self, key: str | None = None):
        self.key, self._made = key or secrets.token_hex(32), {}

    def permutation(self, n: int, tweak: str) -> Derangement:
        if (n, tweak) not in self._made:
            if len(self._made) > 10_000:
                self._made.clear()
            self._made[n, tweak] = Derangement(self.key, n, tweak)
        return self._made[n, tweak]

    def replace(self, kind: str, value: str) -> str | None:
        new = getattr(self, "_" + kind)(value)
        return None if new == value else new

    def _digits(self, value: str, tweak: str, valid=lambda d: True) -> str:
        """Cycle-walking keeps the permutation within the valid values; where value alone is valid it comes back."""
        p, x = self.permutation(10 ** len(value), tweak), int(value)
        while True:
            x = p(x)
            if valid(d := str(x).zfill(len(value))) or d == value:
                return d

    def _card(self, value: str) -> str | None:
        d = re.sub(r"\D", "", value)
        if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
            return None
        body = self._digits(d[:-1], "card", lambda x: len(set(x)) > 1)
        return _into(value, body + luhn_digit(body))

    def _ssn(self, value: str) -> str | None:
        def valid(d: str) -> bool:
            return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

        d = value.replace("-", "")
        return _into(value, self._digits(d, "ssn", valid)) if valid(d) else None

    def _phone(self, value: str) -> str | None:
        d = re.sub(r"\D", "", value)
        if not 10 <= len(d) <= 15:
            return None
        country = re.match(r"\+(\d{1,3})(?=[ .(-])", value)
        lead = country.group(1) if country else "" if not value.startswith("+") else d[: len(d) - 10]
        return _into(value, lead + self._digits(d[len(lead) :], "phone"))

    def _ip(self, value: str) -> str | None:
        parts = value.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts) or int(parts[0]) == 0:
            return None
        x = self.permutation(2**32 - 2**24, "ip")(int.from_bytes(bytes(map(int, parts)), "big") - 2**24) + 2**24
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _date(self, value: str) -> str | None:
        sep = next(c for c in value if not c.isdigit())
        parts = value.split(sep)
        if len(parts) != 3 or not all(p.isdigit() for p in parts):
            return None
        # Places of year, month and day: year first, else day first, else month first.
        for order in [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 1, 0), (2, 0, 1)]:
            try:
                day = datetime.date(*(int(parts[k]) for k in order)).toordinal() - DAY0
            except ValueError:
                continue
            if not 0 <= day < DAYS:
                return None
            new = datetime.date.fromordinal(self.permutation(DAYS, "date")(day) + DAY0)
            width = 1 if any(len(p) == 1 for p in parts) else 2
            for k, x in zip(order, (f"{new.year:04d}", f"{new.month:0{width}d}", f"{new.day:0{width}d}")):
                parts[k] = x
            return sep.join(parts)
        return None

    def _iban(self, value: str) -> str | None:
        x = value.replace(" ", "")
        if not 15 <= len(x) <= 34 or _mod97(x) != 1:
            return None
        body = self._mixed(x[4:], "iban")
        check = 98 - _mod97(x[:2] + "00" + body)
        new = iter(x[:2] + f"{check:02d}" + body)
        return "".join(c if c == " " else next(new) for c in value)

    def _mixed(self, value: str, tweak: str, of=alphabet) -> str:
        """Each character becomes one of its alphabet; those without one stay."""
        sets = [of(c) for c in value]
        n, x = 1, 0
        for chars, c in zip(sets, value):
            if chars:
                x, n = x * len(chars) + chars.index(c), n * len(chars)
        x, out = self.permutation(n, tweak + ":" + "".join(chars[:1] or c for chars, c in zip(sets, value)))(x), []
        for chars, c in zip(reversed(sets), reversed(value)):
            if chars:
                x, r = divmod(x, len(chars))
                out.append(chars[r])
            else:
                out.append(c)
        return "".join(reversed(out))

    def _email(self, value: str) -> str | None:
        """The domain stays: it names the provider."""
        local, _, domain = value.partition("@")
        if sum(c in ALPHANUMERIC for c in local) <= SHORT_NAME and local.isascii():
            return self._mixed(local, "short", lambda c: ALPHANUMERIC if c in ALPHANUMERIC else "") + "@" + domain
        return self._mixed(local, "email") + "@" + domain

    def _aws(self, value: str) -> str | None:
        return "AKIA" + self._mixed(value[4:], "aws")

    def _secret(self, value: str) -> str | None:
        return f"{self.permutation(16 ** len(value), 'hex')(int(value, 16)):0{len(value)}x}"

    def text(self, text: str | None) -> tuple[str | None, int, list[str]]:
        if not text:
            return text, 0, []
        out, at, kinds, start = [], 0, [], 0
        while m := PATTERN.search(text, start):
            kind, value = m.lastgroup, m.group()
            new = None
            if kind != "secret" or CONTEXT.search(text, max(0, m.start() - 24), m.start()):
                new = self.replace(kind, value)
            if new is None and kind in ("secret", "card", "iban"):
                # Not valid as a whole: the next kinds, or a shorter run, may still be.
                new, value, kind = self._retry(kind, value)
            if new is None:
                start = m.start() + max(1, len(re.match(r"\w*", value).group()))  # past its first word
                continue
            out += [text[at : m.start()], new]
            kinds.append(kind)
            at = start = m.start() + len(value)
        return "".join(out) + text[at:], len(kinds), sorted(set(kinds))

    def _retry(self, kind: str, value: str) -> tuple[str | None, str, str]:
        if kind == "secret" and value.isdigit():
            return self.replace("card", value), value, "card"
        if kind == "card":  # a number beside other digits: its longest valid part before a separator
            for end in sorted((m.start() for m in re.finditer(r"[ -]", value)), reverse=True):
                if (new := self.replace("card", value[:end])) is not None:
                    return new, value[:end], "card"
        return None, value, kind


def pseudonymise_udf(spark, key: str):
    shared = spark.sparkContext.broadcast(key)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = Pseudonymiser(shared.value)
        for texts in batches:
            rows = [p.text(t if isinstance(t, str) else None) for t in texts]
            yield pd.DataFrame(rows, columns=["text", "n_pii", "kinds"])

    return F.pandas_udf(run, RESULT)


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str | None = None) -> DataFrame:
    """`docs`, all columns, with pseudonyms in the text column, and n_pii (their number) and kinds (sorted).

    Card numbers (Luhn), IBANs (mod 97), national numbers, phone numbers, IPv4 addresses, dates (1900 to 2099), names of
    mail addresses, access keys and hexadecimal secrets after a word such as token are permuted within their format
    with the key, so a value has one pseudonym in all documents, which differs from it; what fails validation stays as
    it is, and so do mail names without a letter or digit and the domains of mail addresses. Null texts stay null, empty
    ones empty, both with n_pii 0; long texts are treated whole; repeated rows alike. An empty table stays empty. Input
    columns named n_pii or kinds give way. Without a key that of the configuration (KEY_CONF) counts; if there is none,
    one is drawn, and pseudonyms are linked within this result only. Row by row: no shuffle."""
    spark = docs.sparkSession
    key = key or spark.conf.get(KEY_CONF, None) or secrets.token_hex(32)
    (x,) = fresh(docs, "pii")
    with_ = docs.withColumn(x, pseudonymise_udf(spark, key)(docs[text_col]))
    out = replace_columns(with_, n_pii=F.col(x)["n_pii"], kinds=F.col(x)["kinds"])
    return out.withColumn(text_col, F.col(x)["text"]).drop(x)

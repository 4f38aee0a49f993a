"""Shared text functions of the language operators: canonical forms, languages, words."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Letters of other scripts that look like a Latin letter, and those letters.
LOOKALIKES = "АВЕЅІЈКМНОРСТУХԌԚԜаеорсухіјѕһԁԛԝᴠΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳՕօԱ"
LATIN_FOR = "ABESIJKMHOPCTYXGQWaeopcyxijshdqwvABEZHIKMNOPTYXocjOoU"
assert len(LOOKALIKES) == len(LATIN_FOR)
#: The same look-alikes by script: the letters of a script that look Latin, and those Latin letters.
SCRIPT_PAIRS = {
    script: ("".join(a for a, _ in some), "".join(b for _, b in some))
    for script in ("CYRILLIC", "GREEK")
    for some in [list({b: (a, b) for a, b in reversed(list(zip(LOOKALIKES, LATIN_FOR))) if unicodedata.name(a).startswith(script)}.values())]
}

# Hyphens that look like U+002D, and invisible characters outside category Cf.
_HYPHENS = "‐‑﹣－"
_INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10))) + "᠋᠌᠍᠎"


@lru_cache(maxsize=65536)
def _looks(ch: str) -> str:
    """What a character looks like, apart from letters of other scripts."""
    if ch in _HYPHENS:
        return "-"
    if ch in _INVISIBLE or (unicodedata.category(ch) == "Cf"):
        return ""
    if ch in "\r\n\f\v\u0085  ":
        return "\n" if ch in "\u0085  " else ch
    if ch == "\t" or unicodedata.category(ch) == "Zs":
        return " "
    d = unicodedata.decomposition(ch)
    if d.startswith(("<wide>", "<narrow>")):
        return unicodedata.normalize("NFKC", ch)
    if d.startswith("<compat>"):
        k = unicodedata.normalize("NFKC", ch)
        if len(k) > 1 and k.isalpha():  # ligatures
            return k
    return ch


class _Table(dict):
    def __missing__(self, code: int) -> str:
        self[code] = v = _looks(chr(code))
        return v


_TABLE = _Table()


def look(text: str) -> str:
    """Decomposed form in which texts that differ only in width, ligatures, invisible
    characters, kinds of blank or hyphen, composition of accents or blanks at line ends agree.
    Superscripts, fractions, letter case and missing accents stay different."""
    if text.isascii():
        if "\n" not in text and "\r" not in text and "\t" not in text and "\f" not in text and "\v" not in text:
            return text.strip(" ")
        out = text.replace("\t", " ")
    else:
        out = unicodedata.normalize("NFD", unicodedata.normalize("NFC", text.translate(_TABLE)))
    out = out.replace("\r\n", "\n").replace("\r", "\n")
    return "\n".join(l.rstrip(" ") for l in out.split("\n")).strip(" \n")


_TO_LATIN = str.maketrans(LOOKALIKES, LATIN_FOR)


@lru_cache(maxsize=64)  # one text is asked for several times in a row
def plain(text: str) -> str:
    """``look`` with every look-alike letter made Latin, for matching patterns of Latin text."""
    return unicodedata.normalize("NFC", look(text).translate(_TO_LATIN))


_MARKS = re.compile("[\u0300-\u036f]+")


@lru_cache(maxsize=64)
def folded(text: str) -> str:
    """Lower case without accents."""
    low = plain(text).casefold()
    return low if low.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", low).replace("đ", "d"))


# Frequent function words by which languages are told apart.
STOPWORDS = {
    "en": set("the a an of to in on at by for from with and or not is are was were be been it its this that these those which who whom what when where how why does do did can could may might must shall should will would has have had than then as if unless until before after between each every no there their they them he she his her you your i we our but so such more most only also other one two both all any into over under per about against during without within while because".split()),
    "fr": set("a t le la les un une des du de d l au aux et ou ne pas est sont était être été à en dans sur sous par pour avec sans ce cet cette ces qui que quoi quel quelle quels quelles quand où comment pourquoi combien il elle ils elles on nous vous je se son sa ses leur leurs plus moins même si avant après entre chaque tout tous toute toutes comme mais donc ainsi faut peut doit vaut selon lors puis dont y été".split()),
    "vi": set("của và là có không được cho trong các những một này đó với để từ khi nào nếu thì mà bị bởi vì trên dưới tại theo đến ra vào phải sẽ đã đang cũng như về hay hoặc ai gì sao bao nhiêu thế mỗi nhiều ít hơn nhất rất còn lại sau trước giữa bằng việc muốn nên hãy đây đấy rồi chưa mọi cùng nếu lúc thường đều chỉ xong thêm làm cách".split()),
}
#: Vietnamese function words as written without accents, weighed only where no accent occurs, but
#: for those that are function words of another language too.
VI_BARE = {"".join(ch for ch in unicodedata.normalize("NFD", w.replace("đ", "d")) if not unicodedata.combining(ch)) for w in STOPWORDS["vi"]} - STOPWORDS["en"] - STOPWORDS["fr"]
_WORD = re.compile(r"[^\W\d_]+")
_VI_MARK = re.compile("[ăđơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]")


def words(text: str) -> list[str]:
    return _WORD.findall(text)


#: For each function word the languages it belongs to.
_SAYS = {w: [k for k, s in STOPWORDS.items() if w in s] for w in set().union(*STOPWORDS.values())}
_FR_MARK = re.compile("[çèêëîïûœ]")


def language_votes(text: str) -> dict[str, float]:
    """Votes of the words of ``text`` for each language: one for every function word, shared
    words split; accents that only one of the languages has add half a vote."""
    low = plain(text).casefold()
    votes = {"en": 0.0, "fr": 0.0, "vi": 0.0}
    bare = low.isascii()
    for w in _WORD.findall(low):
        of = _SAYS.get(w)
        if of:
            for k in of:
                votes[k] += 1 / len(of)
        if bare:
            votes["vi"] += w in VI_BARE
        elif not w.isascii():
            if _VI_MARK.search(w):
                votes["vi"] += 0.5
            elif _FR_MARK.search(w):
                votes["fr"] += 0.25
    return votes


def language(text: str, margin: float = 1.0) -> str | None:
    """Language with the most votes, or None where no language leads by ``margin`` votes."""
    v = sorted(language_votes(text).items(), key=lambda x: -x[1])
    return v[0][0] if v[0][1] >= 1 and v[0][1] - v[1][1] >= margin else None

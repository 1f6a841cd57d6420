"""Keyword tags and ordered categories.

Both rules are column expressions built from a small dictionary held on the
driver: tags become one alternation regex per class, categories a ``CASE``
chain whose order is the dictionary order (first hit wins).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The bulletin dictionaries, in their original order.
# ---------------------------------------------------------------------------
TAG_SETS: dict[str, list[str]] = {
    "crop": ["벼", "보리", "밀", "콩", "옥수수", "감자", "고구마", "고추", "배추", "무",
             "마늘", "양파", "오이", "토마토", "딸기", "수박", "복숭아", "사과", "배", "포도",
             "감", "인삼", "오미자", "깨", "소", "돼지", "닭", "꿀벌"],
    "task": ["파종", "육묘", "정식", "이앙", "물관리", "비료", "제초", "전정", "적과", "방제",
             "수확", "건조", "저장", "종자신청", "방역", "농기계점검", "요약"],
    "env": ["기상전망", "태풍", "장마", "가뭄", "폭염", "동해", "냉해", "집중호우", "일조량",
            "저수율", "시설하우스", "화재예방", "월동관리"],
    "pest": ["탄저병", "도열병", "흰가루병", "과수화상병", "진딧물", "응애", "총채벌레", "멸구",
             "구제역", "AI", "ASF"],
    "admin": ["PLS", "비료", "보급종", "재해보험", "시범사업", "농약"],
}
# One-syllable particles a one-character tag may carry.
PARTICLES = ["은", "는", "이", "가", "을", "를", "의", "와", "과", "도", "로", "에", "서"]
# Hangul syllable range used as the word boundary for one-character tags.
HANGUL = "가-힣"

CATEGORY_MAP: dict[str, list[str]] = {
    "요약": ["요약", "핵심기술", "주간중점"],
    "기상": ["기상", "전망", "날씨", "저수율", "강수량", "농업정보", "농업정보"],
    "벼": ["벼", "볍씨", "모내기", "쌀", "식량작물", "이앙", "논"],
    "밭작물": ["밭작물", "콩", "감자", "고구마", "보리", "밀", "옥수수", "두류", "잡곡", "맥류"],
    "채소": ["채소", "고추", "마늘", "양파", "배추", "무", "시설하우스", "딸기", "수박", "오이",
           "토마토", "원예"],
    "과수": ["과수", "사과", "배", "포도", "복숭아", "감귤", "단감", "자두", "과원", "동해", "꽃눈"],
    "화훼": ["화훼", "국화", "장미", "프리지아", "카네이션", "꽃"],
    "특용작물": ["특용작물", "인삼", "오미자", "약용작물", "버섯", "느타리", "당귀"],
    "축산": ["축산", "한우", "돼지", "닭", "AI", "구제역", "가축", "방역", "소", "젖소", "양돈",
           "가금", "돈사", "계사"],
    "양봉": ["양봉", "벌통", "꿀벌", "벌집", "봉군", "말벌", "응애", "월동벌", "장수말벌",
           "등검은말벌", "합봉", "사양기"],
}
DEFAULT_CATEGORY = "기타"
SKIP_CATEGORY = "SKIP"
TOC_MARKERS = ["목차", "목 차"]
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _quote(word: str) -> str:
    """Regex-quote a word: escape every character that is not a letter/digit."""
    return "".join(ch if ch.isalnum() else "\\" + ch for ch in word)


def tag_pattern(tags: Sequence[str]) -> tuple[str, int]:
    """The class regex and its number of capture groups.

    One-character tags must not touch a Hangul syllable on either side and may
    carry one particle; longer tags match anywhere. Alternatives keep the
    dictionary order, so the leftmost match and then the first listed tag win.
    """
    one = [_quote(t) for t in tags if len(t) == 1]
    multi = [_quote(t) for t in tags if len(t) > 1]
    parts = []
    if one:
        parts.append(f"(?<![{HANGUL}])((?:{'|'.join(one)}))"
                     f"(?:{'|'.join(PARTICLES)})?(?![{HANGUL}])")
    if multi:
        parts.append(f"((?:{'|'.join(multi)}))")
    # A match can only start at one of the tags' first characters: checking
    # that first rejects most positions at once (groups are unchanged).
    # A class of many characters is slow beyond Latin-1, so a range rejects most before.
    starts = sorted({t[0] for t in tags})
    first = "".join(ch if ch.isalnum() else "\\" + ch for ch in starts)
    wide = [ch for ch in starts if ch > "\xff"]
    near = "".join(ch if ch.isalnum() else "\\" + ch for ch in starts if ch <= "\xff")
    span = f"(?=[{near}{_quote(wide[0])}-{_quote(wide[-1])}])" if wide else ""
    return f"{span}(?=[{first}])(?:{'|'.join(parts)})", len(parts)


def _particle_collision(tags: Sequence[str]) -> bool:
    """True when a longer tag reads as a one-character tag plus a particle,
    so a whole match alone cannot tell which alternative produced it."""
    one = {t for t in tags if len(t) == 1}
    return any(len(t) == 2 and t[0] in one and t[1] in PARTICLES for t in tags)


def extract_tags(text, tags: Sequence[str]) -> Column:
    """F1 + A14: sorted distinct tags of one class found in ``text``.

    Unlike the original ``findall`` use, the full tag is stored for every class
    (the original kept only the first character for classes without
    one-character tags). One regex pass per class: a whole match is either a
    longer tag or a one-character tag with an optional particle, whose first
    character is the tag (two passes are used only for dictionaries where
    that reading is ambiguous). Only texts that contain a tag at all are matched.
    """
    if not tags:
        return F.array().cast("array<string>")
    present = reduce(lambda a, b: a | b, [F.contains(_c(text), F.lit(t)) for t in dict.fromkeys(tags)])
    pattern, groups = tag_pattern(tags)
    multi = [t for t in tags if len(t) > 1]
    if groups == 2 and _particle_collision(tags):
        found = F.concat(F.regexp_extract_all(_c(text), F.lit(pattern), 1),
                         F.regexp_extract_all(_c(text), F.lit(pattern), 2))
    elif groups == 2 or multi == []:
        whole = F.regexp_extract_all(_c(text), F.lit(pattern), 0)
        longer = F.array(*[F.lit(t) for t in multi]) if multi else None
        if longer is None:
            found = F.transform(whole, lambda m: F.substring(m, 1, 1))
        else:
            found = F.transform(whole, lambda m: F.when(
                (F.length(m) == 1) | F.array_contains(longer, m), m).otherwise(F.substring(m, 1, 1)))
    else:
        found = F.regexp_extract_all(_c(text), F.lit(pattern), 1)
    out = F.array_sort(F.array_distinct(F.filter(found, lambda x: x != "")))
    return F.when(present, out).when(_c(text).isNotNull(), F.array().cast("array<string>"))


def tag_columns(df: DataFrame, text, tag_sets: Mapping[str, Sequence[str]] = TAG_SETS,
                prefix: str = "tags_") -> DataFrame:
    """Add one ``tags_<class>`` column per dictionary class."""
    return df.withColumns({f"{prefix}{cls}": extract_tags(text, tags)
                           for cls, tags in tag_sets.items()})


def token_tags(text, vocabulary: Sequence[str]) -> Column:
    """Sorted distinct dictionary words among the lower-cased letter/number
    tokens of ``text`` (one split per text; measured faster than one
    boundary-regex scan per word)."""
    from ..functions.text import tokens
    vocab = F.array(*[F.lit(w) for w in vocabulary])
    return F.array_sort(F.array_intersect(tokens(text), vocab))


def categorize(text, category_map: Mapping[str, Sequence[str]] = CATEGORY_MAP,
               skip_toc: bool = True, default: str = DEFAULT_CATEGORY) -> Column:
    """First category (in dictionary order) with a keyword contained in the
    space-stripped text; ``SKIP`` for a table-of-contents title when
    ``skip_toc`` (the later of the two rule versions), else ``default``."""
    t = _c(text)
    packed = F.replace(t, F.lit(" "), F.lit(""))
    expr = None
    if skip_toc:
        toc = None
        for marker in TOC_MARKERS:
            cond = F.instr(t, marker) > 0
            toc = cond if toc is None else (toc | cond)
        expr = F.when(toc, F.lit(SKIP_CATEGORY))
    for cat, words in category_map.items():
        cond = None
        for w in words:
            c = F.instr(packed, w) > 0
            cond = c if cond is None else (cond | c)
        if cond is None:
            continue
        expr = F.when(cond, F.lit(cat)) if expr is None else expr.when(cond, F.lit(cat))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default))

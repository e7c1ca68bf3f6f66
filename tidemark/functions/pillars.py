"""Sixty-cycle arithmetic on columns: stems 0-9, branches 0-11, elements wood, fire, earth, metal, water as 0-4."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STEMS = "甲乙丙丁戊己庚辛壬癸"
BRANCHES = "子丑寅卯辰巳午未申酉戌亥"
TEN_GODS = ("比肩", "劫财", "食神", "伤官", "偏财", "正财", "七杀", "正官", "偏印", "正印")
ANCHOR_DAY, ANCHOR_INDEX = "2000-01-01", 54  # that day is 戊午, the 55th of the cycle
LONG_LIFE_BRANCH = (11, 6, 2, 9, 2, 9, 5, 0, 8, 3)  # where each stem's first stage falls


def cycle_index(day: Column) -> Column:
    """Index of a date's day pillar in the sixty-cycle."""
    return F.pmod(F.datediff(day, F.to_date(F.lit(ANCHOR_DAY))) + ANCHOR_INDEX, F.lit(60))


def pillar_name(index: Column) -> Column:
    pick = lambda names, at: F.substring(F.lit(names), at + 1, F.lit(1))
    return F.concat(pick(STEMS, index % 10), pick(BRANCHES, index % 12))


def _half(x: Column) -> Column:
    return F.floor(x / 2)


def generates(element: Column) -> Column:
    return (element + 1) % 5


def overcomes(element: Column) -> Column:
    return (element + 2) % 5


def ten_god(day_stem: Column, other: Column) -> Column:
    """Relation of another stem's element to the day stem's, in two by polarity."""
    relation = F.pmod(_half(other) - _half(day_stem), F.lit(5))
    number = relation * 2 + F.when(day_stem % 2 == other % 2, 0).otherwise(1)
    return F.element_at(F.array(*map(F.lit, TEN_GODS)), (number + 1).cast("int"))


def twelve_stage(stem: Column, branch: Column) -> Column:
    """Stages run forwards from the first for even stems, backwards for odd ones."""
    first = F.element_at(F.array(*map(F.lit, LONG_LIFE_BRANCH)), (stem + 1).cast("int"))
    steps = F.when(stem % 2 == 0, branch - first).otherwise(first - branch)
    return F.pmod(steps, F.lit(12)).cast("int")


def clash(a: Column, b: Column) -> Column:
    return F.pmod(a - b, F.lit(12)) == 6


def harmony(a: Column, b: Column) -> Column:
    return (a + b) % 12 == 1


def triple(a: Column, b: Column) -> Column:
    return (a != b) & (F.pmod(a - b, F.lit(4)) == 0)


# branches' partners of the six breaks; groups of branches that punish each other.
BREAK_OF = (9, 4, 11, 6, 1, 8, 3, 10, 5, 0, 7, 2)
PUNISHMENTS = ((2, 5, 8), (1, 10, 7), (0, 3))
SELF_PUNISHED = (4, 6, 9, 11)
# Relations of a day's pillar to one natal pillar; full triples, triple meetings and triple punishments need two natal pillars or more.
RELATIONS = (
    "stem_harmony", "stem_clash", "stem_generates", "stem_generated", "stem_overcomes", "stem_overcome", "stem_same_element", "harmony", "clash", "triple",
    "punish", "self_punish", "harm", "break", "same_branch", "repeat", "reverse", "double_harmony", "double_clash",
)
SUPPORTIVE = ("harmony", "triple", "stem_harmony", "double_harmony", "stem_generates", "stem_same_element")
DISTURBING = ("clash", "punish", "self_punish", "harm", "break", "stem_overcomes", "double_clash", "reverse")
COMPOUND = ("repeat", "reverse", "double_harmony", "double_clash")


def harm(a: Column, b: Column) -> Column:
    return (a + b) % 12 == 7


def breaks(a: Column, b: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, BREAK_OF)), (a + 1).cast("int")) == b


def punish(a: Column, b: Column) -> Column:
    """Two different branches of one group."""
    held = [a.isin(*group) & b.isin(*group) for group in PUNISHMENTS]
    return (a != b) & (held[0] | held[1] | held[2])


def relations(stem: Column, branch: Column, nstem: Column, nbranch: Column) -> Column:
    """Names of the relations of an outer pillar to a natal one, in the order of RELATIONS; triple is two of the three branches."""
    own, other = _half(stem), _half(nstem)
    control, opposed = overcomes(own) == other, F.abs(stem - nstem) == 6
    joined = F.pmod(stem - nstem, F.lit(10)) == 5
    tests = (
        joined, opposed, generates(own) == other, generates(other) == own, control, overcomes(other) == own, own == other,
        harmony(branch, nbranch), clash(branch, nbranch), triple(branch, nbranch), punish(branch, nbranch), (branch == nbranch) & branch.isin(*SELF_PUNISHED),
        harm(branch, nbranch), breaks(branch, nbranch), branch == nbranch, (stem == nstem) & (branch == nbranch),
        (control | opposed) & clash(branch, nbranch), joined & harmony(branch, nbranch), control & clash(branch, nbranch),
    )
    return F.array_compact(F.array(*[F.when(t, name) for name, t in zip(RELATIONS, tests, strict=True)]))


# Beginnings of security codes by exchange and board.
SSE_PREFIXES = ("600", "601", "603", "605", "688", "689", "900")
SZSE_PREFIXES = ("000", "001", "002", "003", "200", "300", "301")
BSE_PREFIXES = ("43", "83", "87", "88", "92")
STAR_PREFIXES, CHINEXT_PREFIXES = ("688", "689"), ("300", "301")
BSE_BOARD_PREFIXES = ("430", "83", "870", "871", "872", "873", "920")
CODE_PREFIXES = (*SSE_PREFIXES, *SZSE_PREFIXES, "430", "835", "873", "888", "920", "777")


def normal_code(raw: Column) -> Column:
    """The first six digits in a row; null if there are none."""
    return F.nullif(F.regexp_extract(raw, r"(\d{6})", 1), F.lit(""))


def _begins(code: Column, prefixes: tuple[str, ...]) -> Column:
    return code.rlike(f"^({'|'.join(prefixes)})")


def exchange_of(code: Column) -> Column:
    """By the code's beginning; null for a null code."""
    return F.when(_begins(code, SSE_PREFIXES), "SSE").when(_begins(code, SZSE_PREFIXES), "SZSE").when(_begins(code, BSE_PREFIXES), "BSE").when(code.isNotNull(), "UNKNOWN")


def board_of(code: Column) -> Column:
    """By the code's beginning, the narrower rules first; null for a null code."""
    main = (*SSE_PREFIXES, *SZSE_PREFIXES)
    return (
        F.when(_begins(code, STAR_PREFIXES), "STAR").when(_begins(code, CHINEXT_PREFIXES), "CHINEXT").when(_begins(code, main), "MAIN")
        .when(_begins(code, BSE_BOARD_PREFIXES), "BSE").when(code.isNotNull(), "UNKNOWN")
    )

"""Text expressions: tokens, act numbers, references, clean-up. All are column expressions, so they stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words that carry no meaning in a query.
STOPWORDS = (
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из "
    "ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам сказал ведь там потом себя ничего ей "
    "может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того "
    "потому этого какой совсем ним здесь этом один почти мой тем чтобы нее были куда зачем всех никогда можно при наконец два об другой "
    "хоть после над больше тот через эти нас про всего них какая много разве три эту моя впрочем хорошо свою этой перед иногда лучше "
    "чуть том нельзя такой им более всегда конечно всю между"
).split()

# Abbreviations of the field and what they stand for.
ABBREVIATIONS = {
    "ко": "кредитная организация",
    "нфо": "некредитная финансовая организация",
    "цб": "банк россии",
    "пвр": "подход на основе внутренних рейтингов",
    "нпф": "негосударственный пенсионный фонд",
    "пос": "портфель однородных ссуд",
    "офр": "организация финансового рынка",
    "уэс": "уполномоченное экономическое соглашение",
    "мсфо": "международные стандарты финансовой отчетности",
    "рсбу": "российские стандарты бухгалтерского учета",
    "од": "операционный день",
    "вса": "внутренняя система аудита",
}

# The forms of a token.
TOKEN = r"(?U)\d+(?:/\d+)?-[а-яa-z]{1,3}(?![а-яa-z])|[а-яa-z]{2,4}-\d+(?:[-/]\d+)+|[а-яёa-z0-9]+"
# Openings of a question that say nothing.
OPENING = r"(?iU)^\s*(?:каков[аоы]?|какой|какие|какая|что\s+(?:такое|является)|в\s+каком\s+порядке|каким\s+образом|как\s+(?:именно\s+)?|подскажите,?\s*|скажите,?\s*|please\s+|)\s*"
# Words, bodies and dates around the number of an act, and the forms of the number.
ACT_WORD = r"(?:положени|инструкци|указани|указ|постановлени|распоряжени|приказ|письм|закон|федеральн\w*\s+закон|регламент|стандарт)\w*"
ORGAN = r"(?:\s+(?:банка\s+россии|правительства(?:\s+рф)?|президента(?:\s+рф)?|цб(?:\s+рф)?))?"
DATE = r"(?:\s*,?\s*от\s+\d{1,2}\.\d{2}\.\d{4}(?:\s*г\.?)?)?"
LETTERED = r"(?:\d+[-–][А-ЯA-Z]{1,3}|[А-Я]{2}-\d+-\d+/\d+)"
NUMBER = rf"(?:(?:№|N|No)\s*(?:{LETTERED}|\d+)|{LETTERED})"
ACT = rf"(?iU)({ACT_WORD}{ORGAN})({DATE}\s*{NUMBER})"
ACT_TAIL = rf"(?U)(?:(?:№|N|No)\s*)?{LETTERED}"
POINTER = (
    r"(?:п\.\s*п\.|пп\.|п\.|подп\.|абз\.|ст\.|гл\.|табл\.|прил\.|"
    r"пункт\w*|подпункт\w*|абзац\w*|стать\w+|глав\w+|таблиц\w+|приложени\w+)"
)
CLAUSES = r"\d+(?:\.\d+)*(?:\s*(?:,|и|или|-|–|—)\s*\d+(?:\.\d+)*)*"
SELF = (
    r"(?iU)\b(?:в|из|по|согласно|исходя\s+из)?\s*(?:этом|этого|этому|данном|данного|данному|настоящем|настоящего|приведённом|приведенном|указанном)\s+"
    r"(?:фрагмент\w*|текст\w*|отрывк\w*|пункт\w*|документ\w*|акт\w*|положени\w*)"
)
SELF_SHORT = r"(?iU)\b(?:этот|этого|данный|данного|настоящий|настоящего)\s+фрагмент\w*"
DASHES = "‐‑‒–—―−"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once; a column expression inside a lambda would be evaluated for every element."""
    return F.transform(F.array(value), body)[0]


def _replace(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


CYRILLIC = "[а-яёА-ЯЁ]"


def split_tokens(text: Column) -> Column:
    """Lower-cased words, numbers and act numbers, ё as е, without function words. Null gives null.

    Function words and ё are Cyrillic, so texts without a Cyrillic letter are spared the steps that deal with them.
    """
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    plain = F.transform(found, lambda t: F.translate(t, "ё", "е"))
    return F.when(text.rlike(CYRILLIC), F.filter(plain, lambda t: ~t.isin(*STOPWORDS))).otherwise(found)


def truncate_tokens(text: Column, n: int = 6) -> Column:
    return F.transform(split_tokens(text), lambda t: F.substring(t, 1, n))


def normalize_query(text: Column) -> Column:
    """Without its opening and with abbreviations written out; the trimmed original where nothing would be left."""
    bare = F.regexp_replace(F.trim(text), OPENING, "")
    parts = F.regexp_extract_all(bare, F.lit(r"(?U)\w+|\W+"), F.lit(0))
    names = F.create_map(*(F.lit(x) for kv in ABBREVIATIONS.items() for x in kv))
    full = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(names, F.lower(p)), p)), "")
    return F.coalesce(F.nullif(F.trim(full), F.lit("")), F.trim(text))


def norm_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(line, DASHES, "-" * len(DASHES)), r"(?U)\s+", " "))


def normalize_number(number: Column) -> Column:
    return F.upper(F.regexp_replace(F.translate(number, DASHES, "-" * len(DASHES)), r"(?U)\s+", ""))


def dehyphenate(text: Column) -> Column:
    """Joins words that a line end cuts after a hyphen; one pass with looks around is the fixed point."""
    return F.regexp_replace(text, r"(?<=[а-яёa-z])-\n(?=[а-яёa-z])", "")


def tidy(text: Column) -> Column:
    out = _replace(text, (r"(?U)\(\s*\)|«\s*»", ""), (r"(?U),(\s*,)+", ","), (r"[ \t]{2,}", " "), (r"(?U)\s+([,.;:?!)»])", "$1"), (r"(?U)([(«])\s+", "$1"), (r"[ \t]{2,}", " "))
    return F.btrim(out, F.lit(" ,;"))


def has_act_number(text: Column) -> Column:
    return text.rlike(ACT) | text.rlike(ACT_TAIL)


def act_numbers(text: Column) -> Column:
    """Lettered numbers in order of first appearance, upper case, with plain dashes."""
    found = F.regexp_extract_all(text, F.lit(rf"(?iU){LETTERED}"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda n: F.translate(F.upper(n), "–—", "--")))


def strip_numbers(text: Column) -> Column:
    return tidy(_replace(text, (ACT, "$1"), (ACT_TAIL, ""), (rf"(?iU)({POINTER})(\s*{CLAUSES})", "$1")))


def strip_references(text: Column) -> Column:
    return tidy(_replace(text, (ACT, ""), (ACT_TAIL, ""), (rf"(?iU){POINTER}\s*{CLAUSES}", "")))


def clean_clauses(clauses: Column) -> Column:
    return F.filter(clauses, lambda c: c.rlike(r"^\d{1,3}(\.\d{1,3})+$"))


def starts_clause(body: Column, clause: Column) -> Column:
    """Whether a line of the body opens with the clause's number and a dot."""
    pattern = F.concat(F.lit(r"(?:^|\n)\s*"), F.replace(clause, F.lit("."), F.lit(r"\.")), F.lit(r"\.\s"))
    return F.regexp_like(body, pattern)


def body_of(text: Column) -> Column:
    """What follows the first empty line; the whole text without one."""
    at = F.instr(text, "\n\n")
    return F.when(at > 0, F.substring(text, at + 2, F.length(text))).otherwise(text)


def language_fault(text: Column) -> Column:
    """Why a question isn't Russian: no letters, more Latin than Cyrillic, letters of a neighbour; null if it is."""
    cyrillic, latin = F.regexp_count(text, F.lit("[а-яёА-ЯЁ]")), F.regexp_count(text, F.lit("[a-zA-Z]"))
    return (
        F.when((cyrillic == 0) & (latin == 0), "без букв")
        .when(latin >= cyrillic, "не по-русски")
        .when(text.rlike("[іїєґІЇЄҐ]"), "не по-русски (соседний язык)")
    )


def refers_to_itself(text: Column) -> Column:
    return text.rlike(SELF) | text.rlike(SELF_SHORT)


def good_source(text: Column, section: Column, least: int = 500, digits: float = 0.18) -> Column:
    """Whether a chunk can carry a question: long enough, few digits and citations, not an annex, some sentences."""
    body = body_of(text)
    n = F.length(body)
    cited = F.regexp_count(body, F.lit(r"ст\. ")) + F.regexp_count(body, F.lit("№ "))
    return (
        (n >= least) & (F.regexp_count(body, F.lit(r"(?U)\d")) / n <= digits) & (cited <= n / 200)
        & ~F.coalesce(section, F.lit("")).startswith("Приложение") & (F.regexp_count(body, F.lit(r"\.")) >= 3)
    )


def html_text(html: Column, gap: str = " ") -> Column:
    """Text of HTML: tags become `gap`, a few entities their characters, white space single."""
    out = F.regexp_replace(html, r"<[^>]+>", gap)
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def shape(number: Column) -> Column:
    return _replace(number, (r"\d+", "9+"), (r"[A-Za-zА-ЯЁа-яё]+", "A+"))


def act_type(number: Column) -> Column:
    return F.regexp_replace(number, r"^.*?[-–]", "")


def year(date: Column) -> Column:
    last = F.right(date, F.lit(4))
    return F.when(last.rlike(r"^\d{4}$"), last.cast("int")).otherwise(0)


def cyrillic_share(text: Column) -> Column:
    c, l = F.regexp_count(text, F.lit("[а-яёА-ЯЁ]")), F.regexp_count(text, F.lit("[a-zA-Z]"))
    return F.when(c + l > 0, c / (c + l)).otherwise(0.0)


def text_verdict(chars: Column, pages: Column, cyrillic: Column, per_page: int = 400, least: float = 0.90) -> Column:
    return (
        F.when(pages == 0, "битый файл")
        .when(chars / F.nullif(pages, F.lit(0)) < per_page, "скан без текстового слоя")
        .when(cyrillic < least, "скан с латинским OCR")
        .otherwise("цифровой")
    )


def question_key(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def clean_answer(text: Column) -> Column:
    """First line of a model's answer without quotes and dashes around it."""
    start = F.regexp_replace(F.trim(text), r"""^[\s"'«»\-–—*]+""", "")
    return F.btrim(F.substring_index(start, "\n", 1), F.lit(" \"'«»"))


def sigmoid(score: Column) -> Column:
    return F.when(score >= 0, 1 / (1 + F.exp(-score))).otherwise(F.exp(score) / (1 + F.exp(score)))


def logit(p: Column, edge: float = 1e-6) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - edge)), F.lit(edge))
    return F.ln(q / (1 - q))


def slug(text: Column) -> Column:
    """Latin letters for Cyrillic ones, everything else single hyphens."""
    out = F.lower(text)
    for a, b in (("ж", "zh"), ("х", "h"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "sch"), ("ю", "yu"), ("я", "ya"), ("ё", "e"), ("ъ", ""), ("ь", "")):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.translate(out, "абвгдезийклмнопрстуфыэ", "abvgdeziiklmnoprstufye")
    return F.btrim(F.regexp_replace(out, "[^a-z0-9]+", "-"), F.lit("-"))


# What a question without an act of the corpus is about, in order.
TOPICS = (
    ("форма отчетности", r"(?iU)\bформ[аеы]\s+0409|\bотчетност"),
    ("федеральный закон", r"(?iU)\d+-ФЗ|федеральн\w+ закон"),
    ("письмо или информационное сообщение", r"(?iU)письм|информационн\w+ сообщени"),
    ("мера поддержки или разъяснение без акта", r"(?iU)мер[аы] (?:по )?поддержк|пандеми"),
)


def topic(section: Column, acts: Column) -> Column:
    """The first topic whose pattern the section or the named acts show; else whether an act was named at all."""
    hay = F.concat(F.coalesce(section, F.lit("")), F.lit(" "), F.array_join(F.coalesce(acts, F.array().cast("array<string>")), " "))
    out = None
    for name, pattern in TOPICS:
        out = F.when(hay.rlike(pattern), name) if out is None else out.when(hay.rlike(pattern), name)
    return out.when(F.coalesce(F.size(acts), F.lit(0)) <= 0, "акт не назван ни в разделе, ни в вопросе").otherwise("назван акт, которого нет в корпусе")


def clause_numbers(text: Column) -> Column:
    """Distinct numbers of clauses with a dot that stand behind a word for a clause."""
    lists = F.regexp_extract_all(text, F.lit(rf"(?iU){POINTER}(\s*{CLAUSES})"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit(r"\d+(?:\.\d+)+"), F.lit(0)))))


def body_under_formula(text: Column, number: Column, date: Column) -> Column:
    """What follows the first empty line if the act's formula stands above it, else the whole text."""
    at = F.instr(text, "\n\n")
    formula = F.concat(F.lit("Банка России № "), number, F.lit(" от "), date)
    return F.when((at > 0) & F.contains(F.substring(text, F.lit(1), at - 1), formula), F.substring(text, at + 2, F.length(text))).otherwise(text)

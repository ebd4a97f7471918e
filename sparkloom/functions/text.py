"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_set(text: Column, least: int = 4) -> Column:
    """Distinct lower-cased runs of letters and digits with ``least`` characters or more."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{Nd}]+")
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) >= least))


def collapse(text: Column) -> Column:
    """White space runs become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))


def clip(text: Column, limit: int, mark: str = "") -> Column:
    """At most ``limit`` characters, with ``mark`` where something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def statement_key(text: Column, letters_only: bool = True) -> Column:
    """Normal form of a statement: lower case, other characters than letters and
    digits become blanks, runs collapse; or lower case and collapse alone (T13)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.trim(F.regexp_replace(low, "[^\\p{L}\\p{Nd}]+" if letters_only else "\\s+", " "))


def citation_refs(answer: Column, sources: Column) -> Column:
    """Numbers cited as [S n], first occurrence order, those above ``sources`` left out."""
    found = F.transform(F.regexp_extract_all(answer, F.lit("\\[S\\s*(\\d{1,4})\\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(found, lambda n: (n >= 1) & (n <= sources)))


def numeric_signals(text: Column, most: int = 3) -> Column:
    """The first distinct numbers with a unit."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(\\d+(?:[.,]\\d+)?\\s?(?:%|°C|mm|cm|m|kg|g|t|MPa|GPa|h|s))(?![\\p{L}])"), F.lit(1))
    return F.slice(F.array_distinct(found), 1, most)


def years(text: Column, head: int = 800, low: int = 1980, high: int = 2027) -> Column:
    """The latest plausible year in the first characters, or null."""
    found = F.transform(F.regexp_extract_all(F.substring(text, 1, head), F.lit("(?<!\\d)((?:19|20)\\d{2})(?!\\d)"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_max(F.filter(found, lambda y: (y >= low) & (y <= high)))


#: Headings that open a list of references or thanks, and how its entries look. Fixed values.
_TAIL = "^\\W{0,6}(references|bibliography|works cited|acknowledge?ments?|список\\s+литератур|литература|библиографи|благодарност)\\b"
_MARKER = "\\[\\s*\\d{1,3}\\s*\\]"
_DOI = "(?i)(doi\\s*[:.]?\\s*|https?://(dx\\.)?doi\\.org/)?10\\.\\d{4,9}/\\S+"
_WORD = "[A-Za-zА-Яа-я]{2,}"


def is_references(text: Column) -> Column:
    """Reference lists: a heading at the start, after numbers, dots and signs of
    headings; five bracketed numbers; or three DOIs, one in 40 words (T11)."""
    bare = F.trim(F.regexp_replace(text, "^\\s+|\\s+$", ""))
    head = F.regexp_replace(F.regexp_replace(F.substring(bare, 1, 120), "\\s+", " "), "^[ .#0-9]+", "")
    words = F.greatest(F.regexp_count(bare, F.lit(_WORD)), F.lit(1))
    dois = F.regexp_count(bare, F.lit(_DOI))
    return (bare != "") & (head.rlike(f"(?iuU){_TAIL}") | (F.regexp_count(bare, F.lit(_MARKER)) >= 5) | ((dois >= 3) & (dois / words > 0.025)))


def is_prose(text: Column) -> Column:
    """200 characters after collapsing, 30 words of two letters and two sentence
    ends or more, and no reference list (T12)."""
    flat = collapse(text)
    enough = (F.length(flat) >= 200) & (F.regexp_count(flat, F.lit(_WORD)) >= 30) & (F.regexp_count(flat, F.lit("[.!?](\\s|$)")) >= 2)
    return enough & ~is_references(flat)


#: What marks a comparison, a chain of clauses, and salient names in a question. Fixed values.
_COMPARES = ("compare", "comparison", "compared to", "versus", "difference", "differ", "trade-?off", "pros and cons", "relationship between", "сравн", "различ", "разниц", "отлич", "взаимосвяз", "соотнош", "по сравнению")
_CLAUSES = ("and", "and then", "as well as", "or")
_CLAUSES_RU = (" и ", " или ", " а также ", " затем ", " потом ")
_QUOTED = "\"[^\"]{1,80}\"|«[^»]{1,80}»"
_NAMES = "[A-ZА-ЯЁ]\\p{L}+(?:[ \\-][A-ZА-ЯЁ]\\p{L}+)+"
_PROPER = "^[A-ZА-ЯЁ]\\p{Ll}+$"


def _edge(side: str) -> str:
    """An end of a word of ASCII letters, digits and underscores, before or behind."""
    return {"before": "(?<![0-9A-Za-z_])", "behind": "(?![0-9A-Za-z_])"}[side]


def entities(question: Column) -> Column:
    """The distinct salient names of a question: quoted spans, capitalised names
    of several words, acronyms of two to six capitals, and capitalised words but
    the first (F15)."""
    acronym = f"{_edge('before')}[A-Z](?:[A-ZА-ЯЁ]{{0,4}}[A-Z]){_edge('behind')}"
    spans = [F.regexp_extract_all(question, F.lit(f"({p})"), F.lit(1)) for p in (_QUOTED, _NAMES, acronym)]
    fields = F.filter(F.split(question, "\\s+"), lambda w: w != "")
    proper = F.filter(F.slice(fields, F.lit(2), F.greatest(F.size(fields), F.lit(1))), lambda w: w.rlike(_PROPER))
    return F.array_distinct(F.transform(F.concat(*spans, proper), lambda x: F.lower(F.trim(x))))


def needs_steps(question: Column, prompt: Column | None = None) -> Column:
    """Whether one retrieval may not answer a question: a comparison counts 2,
    two question marks, two clause markers, two salient names and 18 words 1
    each; from two points on. Never with a prompt of its own (F15)."""
    low = F.lower(question)
    versus = f" vs\\.(?=[0-9A-Za-z_])| vs{_edge('behind')}"
    compare = low.rlike(f"{'|'.join(_COMPARES)}|{versus}").cast("int") * 2
    marks = (F.length(question) - F.length(F.replace(question, F.lit("?"), F.lit(""))) >= 2).cast("int")
    chained = "|".join([f"{_edge('before')}{x}{_edge('behind')}" for x in _CLAUSES] + list(_CLAUSES_RU))
    clauses = (F.regexp_count(low, F.lit(chained)) >= 2).cast("int")
    names = (F.size(entities(question)) >= 2).cast("int")
    long = (F.size(F.filter(F.split(question, "\\s+"), lambda w: w != "")) >= 18).cast("int")
    points = compare + marks + clauses + names + long >= 2
    return points if prompt is None else points & (F.trim(F.coalesce(prompt, F.lit(""))) == "")


#: Words that say nothing about a theme. Fixed values.
STOP_WORDS = """
после также более может должны которые between which
the and for from with without into onto over under
that this these those there where when what how why
have has had were was are is been being can could
should would will may might must all any each some
such than then also via towards toward using used
your our their its his her along
based results research paper study article
abstract introduction method methods table figure
university department school faculty institute center centre
laboratory lab hospital clinic author authors published
conference journal china germany denmark taiwan arizona
heidelberg beijing tsinghua peking medical medicine image
images imaging model models learning deep network networks
framework approach task tasks data dataset datasets
performance evaluation benchmark efficient
название аннотация ключевые слова группа работ
technion israel haifa stanford edu dept cse pes
bengaluru india rwth aachen monash melbourne gmail
com labs cave technology hong kong rio janeiro
coppe federal usa united states massachusetts cambridge
atlanta emory montreal canada zagreb croatia zju
zhejiang hangzhou evanston francisco london king college
chengdu cityu dkfz german los alamos aramco saudi
concordia software computer science
""".split()
#: Words that alone are no label. Fixed values.
GENERIC = """
medical medicine imaging image images learning university
department china germany clinical healthcare multimodal
vision model models framework benchmark technology research
тема медицина изображения обучение университет модель модели
""".split()


def is_generic(label: Column) -> Column:
    """A label without words, of one generic word, or of which all words but at
    most one are generic or stop words (T14)."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), "[^a-zа-я0-9 ]+", " "), " "), lambda w: w != "")
    hits = F.size(F.filter(words, lambda w: w.isin(*GENERIC, *STOP_WORDS)))
    return (F.size(words) == 0) | (hits >= F.greatest(F.lit(1), F.size(words) - 1))


def phrase_tokens(text: Column) -> Column:
    """The words phrases are made of: three letters or more, no numbers, no
    identifiers of papers, no stop words (A21)."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-zа-я0-9+ -]+", " ")
    paper = "^(\\d+|\\d{4,}v\\d+|[a-z]+\\d{4,}v?\\d*)$"
    return F.filter(F.split(clean, " "), lambda w: (F.length(w) >= 3) & ~w.rlike(paper) & ~w.isin(*STOP_WORDS))


def file_route(mime: Column, filename: Column, images: str = "ocr") -> Column:
    """The queue for a file: archive, pdf, email, ``images`` ("ocr" or "vlm"),
    sqlite, else office (S01). Mail is known by its extension at any type; pdf
    and images by their type; archives and databases by either, where the type
    says nothing."""
    ext = F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), "\\.([^.\\\\/]+)$", 1))
    kind = F.lower(F.coalesce(mime, F.lit("")))
    vague = (kind == "") | (kind == "application/octet-stream")
    archive = kind.rlike("(^|[/.-])(zip|x-zip-compressed|x-rar(-compressed)?|vnd.rar|x-7z-compressed|x-tar|gzip|x-gzip|x-bzip2)$") | (vague & ext.isin("zip", "rar", "7z", "tar", "gz", "tgz", "bz2"))
    return (
        F.when(archive, "archive").when(kind.contains("pdf"), "pdf").when(kind.rlike("^message/rfc822$|vnd.ms-outlook") | ext.isin("eml", "msg"), "email")
        .when(kind.startswith("image/"), "vlm" if images.lower() == "vlm" else "ocr").when(kind.contains("sqlite") | (vague & ext.isin("db", "sqlite", "sqlite3")), "sqlite").otherwise("office")
    )


def is_delimited(mime: Column, filename: Column) -> Column:
    """Whether a file is read as a delimited table."""
    name = F.lower(F.coalesce(filename, F.lit("")))
    return name.endswith(".csv") | name.endswith(".tsv") | F.lower(F.coalesce(mime, F.lit(""))).isin("text/csv", "text/tab-separated-values")


#: What files begin with, in hexadecimal digits, as patterns. Fixed values.
MAGIC = (
    ("pdf", "application/pdf", "25504446"), ("zip", "application/zip", "504B0304"), ("gzip", "application/gzip", "1F8B08(00|08)"),
    ("bzip2", "application/x-bzip2", "425A68(39|30)"), ("zstd", "application/zstd", "28B52FFD"), ("7z", "application/x-7z-compressed", "377ABCAF271C"),
    ("rar", "application/vnd.rar", "526172211A07.."), ("png", "image/png", "89504E470D0A1A0A"), ("jpeg", "image/jpeg", "FFD8FF(E0|E1|E2|E3|E8|DB|C0|C4)"),
    ("gif", "image/gif", "47494638(37|39)61"), ("wav", "audio/wav", "52494646.{8}57415645"), ("webp", "image/webp", "52494646.{8}57454250"),
    ("ogg", "application/ogg", "4F676753"), ("flac", "audio/flac", "664C6143"), ("elf", "application/x-elf", "7F454C46"),
    ("pebin", "application/vnd.microsoft.portable-executable", "4D5A(90|00)00"), ("xz", "application/x-xz", "FD377A58585A"), ("mp3", "audio/mpeg", "494433.."),
    ("mp4", "video/mp4", ".{8}66747970.{8}"), ("sqlite", "application/vnd.sqlite3", "53514C69746520666F726D6174203300"),
)
#: Kinds by whole names and by extensions, with how sure they are. Fixed values.
NAMED = (
    ("dockerfile", "text/x-dockerfile", 0.95, "dockerfile", ""), ("yaml", "application/yaml", 0.95, ".gitlab-ci.yml .gitlab-ci.yaml", ""), ("txt", "text/plain", 0.8, ".dockerignore .gitignore .python-version", ""),
    ("python", "text/x-python", 0.95, "", "py"), ("html", "text/html", 0.9, "", "html htm"), ("yaml", "application/yaml", 0.9, "", "yml yaml"), ("shell", "text/x-shellscript", 0.9, "", "sh bash zsh"),
    ("markdown", "text/markdown", 0.9, "", "md markdown"), ("toml", "application/toml", 0.9, "", "toml"), ("txt", "text/plain", 0.7, "", "txt"), ("asm", "text/x-asm", 0.85, "", "asm s"), ("onnx", "application/octet-stream", 0.85, "", "onnx"),
)


def magic_label(content: Column) -> Column:
    """The kind of a file by its first bytes, "unknown" for others."""
    return detected(F.lit(""), content, False)["label"]


def detected(name: Column, content: Column, by_name: bool = True) -> Column:
    """A file's (label, mime, source, confidence): by its first bytes, else by
    its name or extension, else as text if its first 64 bytes are all printable
    ASCII (S23)."""
    head = F.coalesce(F.hex(F.substring(content, 1, 64)), F.lit(""))
    kind = lambda label, mime, source, sure: F.struct(F.lit(label).alias("label"), F.lit(mime).alias("mime"), F.lit(source).alias("source"), F.lit(sure).alias("confidence"))
    out = kind("unknown", "", "unknown", 0.0)
    if by_name:
        out = F.when(head.rlike("^(2[0-9A-F]|[3-6][0-9A-F]|7[0-9A-E]|08|09|0A|0C|0D)+$"), kind("txt", "text/plain", "heuristic", 0.55)).otherwise(out)
        low = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), "([^/]*)$", 1))
        extension = F.regexp_extract(low, "[^.][.]([^.]+)$", 1)
        for label, mime, sure, names, ends in reversed(NAMED):
            out = F.when(low.isin(names.split()) if names else extension.isin(ends.split()), kind(label, mime, "heuristic", sure)).otherwise(out)
    for label, mime, pattern in MAGIC:
        out = F.when(head.rlike(f"^{pattern}"), kind(label, mime, "magic", 1.0)).otherwise(out)
    return out


def breadcrumb(title: Column, section: Column, chunk: Column) -> Column:
    """The chunk under a line of title and section, those there are."""
    some = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.trim(c))
    head = F.concat_ws(" — ", some(title), some(section))
    return F.when(head != "", F.concat(head, F.lit("\n\n"), chunk)).otherwise(chunk)


def valid_offsets(offsets: Column, length: Column) -> Column:
    """Offsets from 0 upwards, each higher than the one before, none beyond the length."""
    rising = F.forall(F.sequence(F.lit(0), F.size(offsets) - 1), lambda i: (i == 0) | (F.get(offsets, i) > F.get(offsets, i - 1)))
    return F.coalesce((F.size(offsets) > 0) & (F.get(offsets, F.lit(0)) == 0) & rising & (F.array_max(offsets) <= length), F.lit(False))


def first_sentence(text: Column, least: int = 24, limit: int = 320) -> Column:
    """Up to the first sentence end after ``least`` characters, at most ``limit``."""
    flat = collapse(text)
    found = F.regexp_extract(flat, f"^.{{{least},}}?[.!?](?= |$)", 0)
    return clip(F.when(found != "", found).otherwise(flat), limit)


def collapse_spaced(text: Column) -> Column:
    """Five or more single letters apart by one or two blanks become one word."""
    run = "(?<![\\p{L}\\p{N}])\\p{L}(?:\\s{1,2}\\p{L}){4,}(?![\\p{L}\\p{N}])"
    parts = F.regexp_extract_all(text, F.lit(f"({run})"), F.lit(1))
    return F.aggregate(parts, text, lambda out, part: F.replace(out, part, F.regexp_replace(part, "\\s", "")))


def sanitise_citations(answer: Column, sources: Column) -> Column:
    """[S n] with n beyond the sources is taken out, spacing mended."""
    bad = F.filter(F.array_distinct(F.regexp_extract_all(answer, F.lit("\\[S\\s*(\\d{1,4})\\]"), F.lit(1))), lambda x: (x.cast("int") > sources) | (x.cast("int") < 1))
    return collapse(F.aggregate(bad, answer, lambda out, x: F.regexp_replace(out, F.concat(F.lit("\\s?\\[S\\s*"), x, F.lit("\\]")), F.lit(""))))


def formula(text: Column) -> Column:
    """The first token that looks like a chemical formula."""
    tokens = F.split(text, "[^A-Za-z0-9]+")
    fits = F.filter(tokens, lambda t: t.rlike("^(?:[A-Z][a-z]?[0-9]*){2,}$") & (F.length(t) >= 2) & (F.length(t) <= 24) & t.rlike("[a-z0-9]"))
    return F.get(fits, F.lit(0))


def extractive_answer(texts: Column, titles: Column, most: int = 3, width: int = 200) -> Column:
    """Up to three sources as "[S i] title: snippet", one a line."""
    lines = F.transform(F.slice(F.arrays_zip(texts.alias("x"), titles.alias("y")), 1, most), lambda s, i: F.concat(F.lit("[S "), (i + 1).cast("string"), F.lit("] "), s["y"], F.lit(": "), clip(collapse(s["x"]), width, "…")))
    return F.array_join(lines, "\n")


#: Words for each direction of a measure. Fixed values.
_FALLS = "decrease|reduc|lower|сниз|уменьш|сократ|минимиз|удешев"
_RISES = "increase|raise|improv|maximi|повыс|увелич|улучш|рост|максимиз"
_STAYS = "maintain|stable|поддерж|сохран|удерж|стабил"


def direction(said: Column, context: Column | None = None) -> Column:
    """Whether a measure should rise, fall or stay: as said, else by words of
    what is said and of its context, of which falling counts first; it should
    rise if nothing is found (T21)."""
    plain = F.lower(collapse(F.coalesce(said, F.lit(""))))
    low = F.lower(F.concat_ws(" ", F.coalesce(said, F.lit("")), context if context is not None else F.lit("")))
    found = F.when(low.rlike(_FALLS), "decrease").when(low.rlike(_RISES), "increase").when(low.rlike(_STAYS), "maintain").otherwise("increase")
    return F.when(plain.isin("increase", "decrease", "maintain"), plain).otherwise(found)


# ---- headings, kinds and highlights

#: What opens captions and headings of chapters. Fixed values.
_CAPTION_WORDS = "рис|рисунок|рисунке|рисунка|табл|таблица|таблице|таблицы|фиг|фигура|схема|формула|уравнение|диаграмма|fig|figure|table|eq|equation|scheme|chart|diagram|plate"
_CHAPTER_WORDS = "глава|раздел|часть|приложение|введение|заключение|аннотация|реферат|список литературы|обозначения|chapter|section|part|appendix|introduction|conclusion|abstract|references|摘要|引言|绪论|实验方法|方法|实验|结果|讨论|结论|参考文献|致谢|§"
_SECTION_NUMBER = "^\\s*\\d+(\\.\\d+){0,4}\\.?\\s+"
_ENDS = "[.!?,;:。！？，；：]$"


def is_heading(line: Column) -> Column:
    """Headings of sections (S16): a number, then a capital, and not like a
    sentence; a word such as Chapter; or a short line in capitals or with most
    words capitalised. Captions and lines with a year are none."""
    p = F.regexp_replace(F.coalesce(line, F.lit("")), "^\\s+|\\s+$", "")
    n = F.length(p)
    fields = F.filter(F.split(p, "\\s+"), lambda w: w != "")
    words = F.size(fields)
    lettered = F.filter(fields, lambda w: w.rlike("^\\p{L}"))
    never = (p == "") | p.rlike(f"(?iu)^\\s*({_CAPTION_WORDS})[^\\p{{L}}\\d]{{0,3}}\\d") | p.rlike("(?<![0-9A-Za-z_])(19|20)\\d\\d(?![0-9A-Za-z_])")
    body = F.regexp_replace(p, _SECTION_NUMBER, "")
    after = F.trim(F.regexp_extract(body, "(?s)^[^.]*\\.(.*)$", 1))
    later = F.size(F.filter(F.split(after, "\\s+"), lambda w: w != ""))
    sentence = ((n > 80) & (words > 12)) | (p.rlike(_ENDS) & p.contains(",")) | (after.contains(" ") & (later >= 3))
    numbered = (n <= 140) & p.rlike(f"{_SECTION_NUMBER}\\p{{L}}") & body.rlike("^[\\p{L}&&[^\\p{Ll}]]") & ~sentence
    chapter = (n <= 140) & p.rlike(f"(?iu)^\\s*({_CHAPTER_WORDS})([^\\p{{L}}]|$)") & ~p.rlike(_ENDS)
    letters, capitals = F.regexp_count(p, F.lit("\\p{L}")), F.regexp_count(p, F.lit("\\p{Lu}"))
    upper = (letters > 0) & (capitals / letters >= 0.6)
    titled = (F.size(lettered) >= 2) & (2 * F.size(F.filter(lettered, lambda w: w.rlike("^\\p{Lu}"))) > F.size(lettered))
    short = (n <= 80) & (words <= 12) & ~p.rlike(_ENDS) & ~p.rlike("[,;]") & (upper | titled)
    return ~never & (numbered | chapter | short)


def kind_of_file(filename: Column, title: Column) -> Column:
    """Documents of hypotheses by their name or title; "" for others."""
    named = lambda c: F.coalesce(c, F.lit("")).contains("ипотез")
    return F.when(named(filename) | named(title), "hypotheses").otherwise("")


def kind_of_text(text: Column) -> Column:
    """Documents of hypotheses by the first 400 letters: the word at the start
    of the first line and a numbered list, or the word and a brainstorm (F13)."""
    head = F.substring(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "^\\s+|\\s+$", "")), 1, 400)
    line = F.trim(F.regexp_extract(head, "^([^\\r\\n]*)", 1))
    listed = line.startswith("гипотез") & (head.contains("1.") | head.contains("1)"))
    return F.when(listed | (head.contains("гипотез") & head.contains("мозгово")), "hypotheses").otherwise("")


def highlighted(text: Column, query: str) -> Column:
    """The text in parts (part, hit): a hit is a word of the query of three
    letters or more, or a Chinese one, in either case, ё as е (T26)."""
    import re

    flat = query.lower().replace("ё", "е")
    terms = [t for t in re.split(r"[^\w]+|_", flat) if len(t) >= 3 or re.search("[一-鿿]", t)]
    if not terms:
        return F.array(F.struct(text.alias("part"), F.lit(False).alias("hit")))
    pattern = "|".join(re.escape(t).replace("е", "[её]") for t in terms)
    parts = F.split(F.regexp_replace(text, f"(?iu)({pattern})", "\u0001$1\u0001"), "\u0001")
    marked = F.transform(parts, lambda x, i: F.struct(x.alias("part"), (i % 2 == 1).alias("hit")))
    return F.filter(marked, lambda x: x["part"] != "")


def merged_json(whole: Column, key: str, value: Column) -> Column:
    """A JSON object with one key set to a JSON value; what is no object counts as {}."""
    kept = F.coalesce(F.from_json(F.when(F.trim(whole).startswith("{"), whole), "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    return F.to_json(F.map_concat(F.map_filter(kept, lambda k, _: k != key), F.create_map(F.lit(key), F.parse_json(value))))


def price_list(setting: Column) -> Column:
    """[(match, prompt, completion)] of "name=in/out;name=in/out", names lower-cased;
    entries of another form are left out, unreadable numbers are 0 (M12)."""
    entries = F.filter(F.transform(F.split(F.coalesce(setting, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x.rlike("^[^=]*\\S[^=]*=[^/]*/"))
    number = lambda x: F.coalesce(F.trim(x).try_cast("double"), F.lit(0.0))
    rates = lambda x: F.regexp_extract(x, "^[^=]*=(.*)$", 1)
    return F.transform(entries, lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, "^([^=]*)=", 1))).alias("match"), number(F.regexp_extract(rates(x), "^([^/]*)/", 1)).alias("prompt"), number(F.regexp_extract(rates(x), "^[^/]*/(.*)$", 1)).alias("completion")))

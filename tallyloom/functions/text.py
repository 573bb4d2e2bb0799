"""Review text: cleaning, star-only detection, hashes, rule categories and small parsers.

Everything is Column expressions.  Patterns run with Unicode classes, so that Thai
letters and digits count as letters and digits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyloom.functions import domain
from tallyloom.functions.filters import let, matches_any, starts_with_any

# Words and patterns of review cards.
PRIVATE_USE = "[\ue000-\uf8ff]"
DROP_EXACT = ("ชอบ", "แชร์", "เพิ่มเติม", "ใหม่", "แนะนำการแก้ไข", "ตอบกลับ")
DROP_PREFIX = (
    "Local Guide",
    "ประเภทการสั่ง",
    "รับประทานที่ร้าน",
    "ซื้อกลับบ้าน",
    "บริการเดลิเวอรี",
    "ราคาต่อคน",
    "ประเภทสถานที่",
    "บริการ:",
    "อาหาร:",
    "บรรยากาศ:",
    "ราคา:",
    "ความคุ้มค่า",
    "แนะนำสำหรับ",
    "ที่จอดรถ:",
    "ไปที่นี่ใน",
    "เยี่ยมชมเมื่อ",
    "ประเภทอาหาร",
    "มื้ออาหาร",
)
META_LINE = r"^·?\s*\d[\d,]*\s*รีวิว(\s*·.*)?$"
META_NEXT = r"^·?\s*\d+\s*รีวิว"
COUNT_LINE = r"^\+?\d+$"
DATE_LINE = (
    r"^\s*(?:(?:แก้ไขเมื่อ|เยี่ยมชมเมื่อ)\s*(?:วันที่)?\s*)?(?:(?:\d+|a|an)\s*)?"
    r"(?:วินาที|นาที|ชั่วโมง|วัน|สัปดาห์|เดือน|ปี|second|minute|hour|day|week|month|year)s?\s*(?:ที่แล้ว|ago)?\s*$"
)
TODAY_LINE = r"^\s*(วันนี้|เมื่อวาน(?:นี้)?|today|yesterday)\s*$"
CUT_MARKERS = ("คำตอบจากเจ้าของ", "แปลโดย Google", "Response from the owner")
TAILS = (r"(?:[…\.]{1,3}\s*)?เพิ่มเติม\s*(?:\d+:\d+)?\s*$", r"\s*\d+:\d+\s*$", r"[…\.]{1,3}\s*$")
STAR_DATE, STAR_UNIT, STAR_TODAY = r"(ที่แล้ว|ที่ผ่านมา|ago)", r"(วัน|สัปดาห์|เดือน|ปี|day|week|month|year)", r"^(เมื่อวาน|วันนี้|yesterday|today)"
STAR_NOISE = (
    "^[\ue000-\uf8ff\\s]+$",
    r"^(อาหาร|บริการ|บรรยากาศ|ห้องพัก|สถานที่ตั้ง|ความสะอาด|ความคุ้มค่า|Rooms|Service|Location|Cleanliness|Value|Food|Atmosphere)\s*:",
    r"^(ประเภทอาหาร|ราคาต่อคน|ประเภทการสั่ง|ประเภทการเดินทาง|กลุ่มท่องเที่ยว|คืนที่พัก|มื้ออาหาร|บริการที่แนะนำ|จุดเด่น|ความเห็นเกี่ยวกับ)",
    r"^(฿[\d,\-–\s]+|อาหารเช้า|อาหารกลางวัน|อาหารเย็น|อาหารมื้อสาย|รับประทานที่ร้าน|สั่งกลับบ้าน|เดลิเวอรี|ซื้อกลับบ้าน|อื่นๆ)\s*…?$",
    r"^(เพิ่มเติม|ดูเพิ่มเติม|ดูคำแปล|ชอบ|แชร์|ใหม่|Like|Share|More)\s*$",
)
OWNER = "คำตอบจากเจ้าของ"
RULE_CATEGORIES = {
    "การเดินทางและที่จอดรถ": ("จอดรถ", "เดินทาง", "ถนน", "ทาง", "รถ", "ที่จอด", "จราจร", "สัญญาณ"),
    "ความสะอาดและสิ่งแวดล้อม": ("สกปรก", "ขยะ", "กลิ่น", "ความสะอาด", "ห้องน้ำ", "เหม็น", "ทิ้ง"),
    "ราคาและความคุ้มค่า": ("แพง", "ราคา", "ค่าใช้จ่าย", "คุ้มค่า", "ค่าบริการ", "ค่าเข้า", "ค่า"),
    "การบริการและเจ้าหน้าที่": ("บริการ", "เจ้าหน้าที่", "พนักงาน", "ช่วยเหลือ", "ไม่สุภาพ", "หยาบ", "แนะนำ"),
    "ความปลอดภัย": ("อันตราย", "ลื่น", "ชัน", "ราวจับ", "ไม่ปลอดภัย", "เสี่ยง", "ระวัง"),
    "สิ่งอำนวยความสะดวก": ("ที่นั่ง", "ร้านอาหาร", "ร้านค้า", "อำนวยความสะดวก", "ร่มเงา", "น้ำดื่ม"),
    "ข้อมูลและป้ายบอกทาง": ("ป้าย", "ข้อมูล", "บอกทาง", "แผนที่", "อธิบาย", "ไม่ชัดเจน", "หลงทาง"),
    "ความแออัดและการจัดการ": ("แน่น", "คนเยอะ", "คิวยาว", "รอนาน", "แออัด", "จัดการ"),
    "พ่อค้าแม่ค้าและการรบกวน": ("คนขายของ", "รุม", "หลอก", "รบกวน", "ขายของ", "โฆษณา"),
}
UI_BUTTONS = (
    "เพิ่มเว็บไซต์",
    "เพิ่มเวลาทำการ",
    "เพิ่มหมายเลขโทรศัพท์",
    "เพิ่มรูปภาพ",
    "เพิ่มข้อมูล",
    "อ้างสิทธิ์",
    "แนะนำการแก้ไข",
    "ยืนยันธุรกิจนี้",
    "Add a website",
    "Add hours",
    "Add phone",
    "Claim this",
    "Suggest an edit",
)
NOISE = r"http\S+|www\.\S+|<[^>]+>|[\x{10000}-\x{10ffff}]|[^฀-๿\w\s]"
DAYS = {"จันทร์": "จ", "อังคาร": "อ", "พุธ": "พ", "พฤหัสบดี": "พฤ", "ศุกร์": "ศ", "เสาร์": "ส", "อาทิตย์": "อา"}
HOURS_NOISE = ("รูปภาพ", "ผู้รีวิว", "ช่วงราคา", "รายงาน", "ต่อคน")
HOURS_RANGE = r"(\d{1,2}:\d{2})\s*(?:ถึง|[-–—])\s*(\d{1,2}:\d{2})"
PLACE_AT, VIEW_AT, VIEW_NO_ZOOM = r"!3d(-?\d+\.\d+)!4d(-?\d+\.\d+)", r"@(-?\d+\.\d+),(-?\d+\.\d+),(\d+(?:\.\d+)?)z", r"@(-?\d+\.\d+),(-?\d+\.\d+)"
LEAST_ZOOM = 15.0
# End of fixed values.


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _is(line: Column, pattern: str, fold: bool = False) -> Column:
    return line.rlike(("(?iuU)" if fold else "(?U)") + pattern)


def clean_review_text(raw: Column) -> Column:
    """The words of the reviewer alone: icons, buttons, names, dates and owner's answers go."""
    lines = F.transform(F.split(F.coalesce(raw, F.lit("")), "\n"), lambda x: strip(F.regexp_replace(x, PRIVATE_USE, "")))

    # One pattern a line, and one for the line behind it.
    quoted = lambda words: "|".join(f"\\Q{w}\\E" for w in words)
    gone = f"(?U)^$|^(?:{quoted(DROP_EXACT)})$|^(?:{quoted(DROP_PREFIX)})|(?iu:{DATE_LINE}|{TODAY_LINE})|{META_LINE}|{COUNT_LINE}"
    stays = lambda p: ~(p["line"].rlike(gone) | p["next"].rlike(f"(?U)^Local Guide|{META_NEXT}"))
    following = lambda own: F.concat(F.slice(own, 2, F.size(own)), F.array(F.lit("")))
    paired = let(lines, lambda own: F.zip_with(own, following(own), lambda a, b: F.struct(a.alias("line"), b.alias("next"))))
    text = F.array_join(F.transform(F.filter(paired, stays), lambda p: p["line"]), " ")
    text = F.regexp_replace(text, f"(?s)(?:{'|'.join(CUT_MARKERS)}).*$", "")
    for tail in TAILS:
        text = strip(F.regexp_replace(text, "(?U)" + tail, ""))
    return F.regexp_replace(text, r"(?U)\s{2,}", " ")


def is_rating_only(raw: Column) -> Column:
    """Whether a card has stars but no words: nothing but noise after its date line."""
    is_date = lambda x: (_is(x, STAR_DATE, True) & _is(x, STAR_UNIT, True)) | _is(x, STAR_TODAY, True)
    is_noise = lambda x: (x == "") | reduce(lambda a, b: a | b, (_is(x, p) for p in STAR_NOISE))

    def first(lines: Column, test) -> Column:
        return F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull()))

    def verdict(x: Column) -> Column:
        between = F.slice(x["lines"], x["date_at"] + 2, F.greatest(x["owner_at"] - x["date_at"] - 1, F.lit(0)))
        return F.when(x["date_at"].isNull() | (x["date_at"] >= x["owner_at"]), False).otherwise(F.forall(between, is_noise))

    def places(lines: Column) -> Column:
        owner_at = F.coalesce(first(lines, lambda x: x.startswith(OWNER)), F.size(lines))
        return let(F.struct(lines.alias("lines"), first(lines, is_date).alias("date_at"), owner_at.alias("owner_at")), verdict)

    return let(F.transform(F.split(F.coalesce(raw, F.lit("")), "\n"), strip), places)


def effective_text(clean: Column, raw: Column) -> Column:
    """The cleaned text, or else the raw one without spaces at its ends."""
    return F.coalesce(F.nullif(clean, F.lit("")), F.trim(raw))


def review_text_hash(raw: Column) -> Column:
    """md5 of the first 1000 characters of the cleaned text, or of the raw text if that is empty."""
    cleaned = lambda bare: let(F.substring(clean_review_text(bare), 1, 1000), lambda clean: F.when(clean == "", bare).otherwise(clean))
    return let(strip(F.coalesce(raw, F.lit(""))), lambda bare: F.md5(cleaned(bare)))


def rule_categories(text: Column) -> Column:
    """All categories with one of their words in the text, in fixed order; other if none."""
    found = lambda t: F.filter(F.array(*(F.when(matches_any(t, words), F.lit(c)) for c, words in RULE_CATEGORIES.items())), lambda x: x.isNotNull())
    return let(let(text, found), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit(domain.OTHER))))


def sentiment_from_rating(rating: Column) -> Column:
    return F.when(rating >= 4, "positive").when(rating <= 2, "negative").otherwise("neutral")


def severity_from_rating(rating: Column) -> Column:
    return F.when(rating.isNull() | (rating == 2), "medium").when(rating == 1, "high").otherwise("low")


def severity_gate(sentiment: Column, category: Column, rating: Column) -> Column:
    """Severity where a model gave the labels: low unless a negative problem."""
    problem = (sentiment == "negative") & ~F.coalesce(category, F.lit("")).isin(*domain.NON_PROBLEM)
    return F.when(F.coalesce(problem, F.lit(False)), severity_from_rating(rating)).otherwise("low")


def clean_noise(text: Column) -> Column:
    """Without links, markup, emoji and symbols."""
    # No other white space than single spaces is left to be trimmed.
    return F.trim(F.regexp_replace(F.regexp_replace(text, "(?U)" + NOISE, " "), r"(?U)\s+", " "))


def tokens(text: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Words of two characters and more, without stop words; split at white space.

    Another tokenizer can be put before this: its words joined by spaces are such a text.
    """
    words = F.filter(F.split(clean_noise(text), " "), lambda w: F.length(w) >= 2)
    return F.filter(words, lambda w: ~w.isin(*stop_words)) if stop_words else words


def keywords(text: Column, stop_words: tuple[str, ...] = (), most: int = 10) -> Column:
    return F.slice(tokens(text, stop_words), 1, most)


def ellipsis(text: Column, most: int = 60) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def weekly_hours(rows: Column) -> Column:
    """Opening hours of a week from an array of labels, one a day; null if no day is named."""
    names = list(DAYS)
    usable = F.filter(rows, lambda r: r.isNotNull() & ~matches_any(r, HOURS_NOISE))

    def of_day(raw: Column, day: str) -> Column:
        rest = F.regexp_replace(F.regexp_replace(raw, f"(?s)^.*?{day}", ""), PRIVATE_USE, " ")
        starts, ends = F.regexp_extract_all(rest, F.lit(HOURS_RANGE), 1), F.regexp_extract_all(rest, F.lit(HOURS_RANGE), 2)
        ranges = F.array_join(F.zip_with(starts, ends, lambda a, b: F.concat(a, F.lit("-"), b)), ", ")
        open_ = F.when(rest.contains("24") & matches_any(raw, ("ชั่วโมง", "ตลอด")), "24 ชม.").when(ranges != "", ranges).otherwise("ปิด")
        return F.when(raw.isNotNull(), F.struct(F.lit(DAYS[day]).alias("day"), open_.alias("hours")))

    def last(usable: Column, i: int) -> Column:
        own = F.filter(usable, lambda r: r.contains(names[i]) & ~matches_any(r, names[:i]))
        return let(F.try_element_at(own, F.lit(-1)), lambda raw: of_day(raw, names[i]))

    def week(found: Column) -> Column:
        times = F.array_distinct(F.transform(found, lambda x: x["hours"]))
        each = F.array_join(F.transform(found, lambda x: F.concat(x["day"], F.lit(" "), x["hours"])), " | ")
        return F.when((F.size(found) == 7) & (F.size(times) == 1), F.concat(F.lit("ทุกวัน "), F.get(times, 0))).when(F.size(found) > 0, each)

    days = let(usable, lambda u: F.filter(F.array(*(last(u, i) for i in range(7))), lambda x: x.isNotNull()))
    return let(days, week)


def coordinates_of_url(url: Column) -> Column:
    """(lat, lng): the place's own, or the middle of a near view; null for a far one."""
    at = lambda pattern: F.struct(F.regexp_extract(url, pattern, 1).try_cast("double").alias("lat"), F.regexp_extract(url, pattern, 2).try_cast("double").alias("lng"))
    near = F.regexp_extract(url, VIEW_AT, 3).try_cast("double") >= LEAST_ZOOM
    return F.when(url.rlike(PLACE_AT), at(PLACE_AT)).when(url.rlike(VIEW_AT), F.when(near, at(VIEW_AT))).when(url.rlike(VIEW_NO_ZOOM), at(VIEW_NO_ZOOM))


def is_ui_button(text: Column) -> Column:
    return starts_with_any(strip(F.coalesce(text, F.lit(""))), UI_BUTTONS)


def parse_rating(text: Column) -> Column:
    """``4,1`` or ``4.1`` as a number, or null."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def count_type_matches(types: Column, wanted: Column) -> Column:
    """Elements of an array of comma-joined types that hold one type."""
    return F.size(F.filter(types, lambda t: F.array_contains(F.split(t, ","), wanted)))


def query_term(name: Column, search_query: Column) -> Column:
    """What to look a place up by: its name where that differs from the old query."""
    own, old = F.coalesce(name, F.lit("")), F.coalesce(search_query, F.lit(""))
    return F.when((own != "") & (old != "") & (own != old), name).otherwise(F.coalesce(F.nullif(search_query, F.lit("")), name))


LABELLED = T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("category", T.StringType()), T.StructField("sentiment", T.StringType())]))


def parse_labels(responses: DataFrame, column: str, batch: DataFrame, categories=domain.CATEGORY_KEYS) -> DataFrame:
    """(id, category, sentiment) rows of JSON answers: fences go, ids must be in ``batch`` and categories known."""
    bare = F.regexp_replace(strip(F.col(column)), r"(?s)^```(?:json)?\s*|\s*```$", "")
    rows = responses.select(F.inline(F.from_json(bare, LABELLED)))
    return rows.join(batch.select("id"), "id", "left_semi").where(F.col("category").isin(*categories))

"""Fixed values of the domain, kept in one place."""

from __future__ import annotations

# Categories, labels, thresholds and places of the review domain.
GENERAL = "ความคิดเห็นทั่วไป (ไม่ระบุปัญหา)"
OTHER = "อื่นๆ"
NON_PROBLEM = (GENERAL, OTHER, "ไม่มี")
CATEGORY_KEYS = (
    "การบริการและเจ้าหน้าที่",
    "การเดินทางและที่จอดรถ",
    "ข้อมูลและป้ายบอกทาง",
    "ความคิดเห็นทั่วไป (ไม่ระบุปัญหา)",
    "ความปลอดภัย",
    "ความสะอาดและสิ่งแวดล้อม",
    "ความแออัดและการจัดการ",
    "บรรยากาศและการตกแต่งร้าน",
    "รสชาติและคุณภาพอาหาร/เครื่องดื่ม",
    "ราคาและความคุ้มค่า",
    "สิ่งอำนวยความสะดวก",
    "อื่นๆ",
)
CATEGORY_LABELS = {"การบริการและเจ้าหน้าที่": "การบริการของพนักงานร้าน"}
SENTIMENTS = ("positive", "neutral", "negative")
SEVERITIES = ("high", "medium", "low")
CLOSED = ("closed_permanently", "closed_temporarily")
ZONE_LABELS = {"naresuan": "รอบ ม.นเรศวร", "rajabhat": "รอบ ม.ราชภัฏ", "city_center": "ตัวเมือง", "other": "อื่นๆ พิษณุโลก"}
#: Zone: latitude and longitude of its centre, radius in km.
ZONES = {"naresuan": (16.7442, 100.1956, 2.0), "rajabhat": (16.8299369, 100.2075576, 2.0), "city_center": (16.8258, 100.2654, 2.0)}
#: Province: least and greatest latitude, least and greatest longitude.
BBOX = (16.35, 17.35, 100.05, 101.2)
SERVE_CEILING = 850
REFRESH_CAP = 200
DEEP_MIN_RATIO = 0.5
DEEP_MAX_ATTEMPTS = 3
DEEP_CAPPED, DEEP_SHALLOW, DEEP_GAP = 190, 50, 50
LOW_CONFIDENCE_MIN = 30
YIELD_MIN, YIELD_LEAST_EXPECTED = 0.40, 200
#: Days to wait by the number of scans in a row that brought nothing.
COOLDOWN_DAYS = {0: 7, 1: 7, 2: 14}
COOLDOWN_LAST = 30
THAI_MONTHS = ("มกราคม", "กุมภาพันธ์", "มีนาคม", "เมษายน", "พฤษภาคม", "มิถุนายน", "กรกฎาคม", "สิงหาคม", "กันยายน", "ตุลาคม", "พฤศจิกายน", "ธันวาคม")
BUDDHIST_OFFSET = 543
PLACE_TYPES = ("คาเฟ่", "ร้านอาหาร", "สถานที่ท่องเที่ยว", "ทั่วไป")
# End of fixed values.

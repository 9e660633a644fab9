"""Fixed values that results depend on.

Everything in the FIXED VALUES block must equal what the dashboard this
library re-implements uses (word lists, labels, limits, coordinates,
formats).  It is stated once, in natural order, and imported everywhere
else.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the original dashboard for identical results)
# ---------------------------------------------------------------------------

# Call flag tokens (after strip + lower).
FLAG_DONE = ["evet", "yes", "1"]
FLAG_NOT_DONE = ["hayır", "hayir", "no", ""]
# Close reasons that mark a low-quality record (after strip + lower).
LOW_QUALITY_REASONS = ["bilgi verildi", "bilgi"]
# Test drive status tokens meaning "done" (after strip + lower).
TEST_DRIVE_DONE = ["yapıldı", "yapildi"]
# Exact flag value used by the team performance page (case-sensitive).
CALLED_EXACT = "Evet"
# Text that marks a deleted note line, and the tombstone written on delete.
DELETED_MARK = "MESAJ SİLİNDİ"
# Words shown for the warranty countdown.
WARRANTY_YEARS_LEFT = "Yıl Kaldı"      # "{n} Yıl Kaldı"
WARRANTY_ENDS_THIS_YEAR = "Bu Yıl Bitiyor"
WARRANTY_EXPIRED = "Süresi Doldu"
WARRANTY_YEARS = 6
WARRANTY_SEGMENT_AGE = 3
TRADE_IN_KM = 60000
# Placeholder texts.
NO_DATA_REASON = "Veri Yok"
UNKNOWN_STATION = "Bilinmeyen Şarj İstasyonu"
PENDING_STATUS = "İşlem Bekliyor"
DEFAULT_BIRTHDAY_NAME = "Kayıtlı Müşteri"
ALL_STAFF = "HEPSİ"
REMINDER_SUFFIX = " (⏰ Hatırlatıcı Kuruldu: {})"
# Daily goal per person.
DAILY_GOAL = 35
# Reminder alert window: seconds before / after the due time.
REMINDER_EARLY_S = 300
REMINDER_LATE_S = 7200
REMINDER_POLL_S = 20
# Station feed: bounding box and cache age.
STATION_LAT = (35.8, 42.1)
STATION_LON = (25.6, 44.8)
STATION_AMENITY = "charging_station"
STATION_TTL_S = 3600
# Map jitter half-width in degrees.
GEO_JITTER_DEG = 0.008
# Login lockout limits.
MAX_ATTEMPTS = 5
LOCKOUT_S = 180
# Table page size.
PAGE_SIZE = 12
# Performance periods in days.
PERIODS = [7, 30, 365]
# City dimension: normalised city key -> (lat, lon).
CITIES = [
    ("ADANA", 37.0, 35.32),
    ("MERSIN", 36.82, 34.61),
    ("HATAY", 36.2, 36.15),
    ("OSMANIYE", 37.07, 36.24),
    ("GAZIANTEP", 37.06, 37.38),
    ("ISTANBUL", 41.01, 28.97),
    ("ANKARA", 39.92, 32.85),
    ("IZMIR", 38.42, 27.14),
    ("ANTALYA", 36.89, 30.71),
    ("BURSA", 40.18, 29.06),
]
# City normalisation: upper-case letters mapped to ASCII.
CITY_FROM = "İŞÇĞÜÖ"
CITY_TO = "ISCGUO"
NOTE_TS_PATTERN = r"\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}"
NOTE_TS_FORMAT = "dd.MM.yyyy HH:mm"
DISPLAY_DATE_FORMAT = "dd-MM-yyyy"
DISPLAY_REMINDER_FORMAT = "dd-MM-yyyy HH:mm"
LOG_TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
# Mon-first weekday headers of the birthday calendar.
# Audit log action types and detail texts ({} = customer name / id / file).
AUDIT_OUTCOME = ("Müşteri İşlemi", "Müşteri: {} (No: {}) paneli üzerinden güncelleme yapıldı.")
AUDIT_ADMIN = ("Yönetici Düzenlemesi", "Müşteri (No: {}) bilgileri yönetici tarafından güncellendi.")
AUDIT_DELETE = ("Not Silme İşlemi", "{} numaralı müşterinin geçmiş notu silindi.")
AUDIT_COMPLETE = ("Hatırlatıcı Tamamlandı",
                  "Müşteri: {} (No: {}) için kurulan hatırlatıcı danışman tarafından onaylandı ve kapatıldı.")
AUDIT_EXPORT = ("Excel Dışa Aktarım", "'{}' isimli tablo bilgisayara indirildi.")
AUDIT_LOG_EXPORT = ("Logları Dışa Aktardı", "Sistem logları excele aktarıldı.")
UNKNOWN_CUSTOMER = "Bilinmeyen Müşteri"
UNKNOWN_USER = "Bilinmeyen Kullanıcı"
UNKNOWN_NAME = "Bilinmiyor"
# Team evaluation texts ({0} = total calls, {1} = staff name; insight: {0} =
# top reason, {1} = its count).
TEAM_TITLE_ALL = "Tüm Ekip Genel Değerlendirme"
TEAM_TITLE_ONE = "{1} - Performans Özeti"
TEAM_COMMENTS = {
    "active": "Seçilen dönemde toplam {0} arama ile aktif ve yoğun bir performans sergileniyor.",
    "low": "Seçilen dönemde toplam {0} arama yapıldı. Arama hacmi artırılabilir.",
    "very_good": "🌟 Çok İyi: Toplam {0} görüşme ile oldukça yüksek efor sarf ediyor. Motivasyonu desteklenmeli.",
    "good": "👍 İyi: Toplam {0} arama ile istikrarlı bir ilerleyişi var.",
    "needs_work": "⚠️ Gelişime Açık: Toplam {0} aramada kaldı. Görüşme hacmini artırması önerilir.",
}
TEAM_INSIGHT = "En çok '{0}' sebebiyle ({1} kez) kapanış yapılmış."
TEAM_NO_INSIGHT = "Müşterilerin net bir kapanış veya reddedilme sebebi henüz girilmemiş."
# Export file name stems per report.
EXPORT_STEMS = {
    "test_drive": "Test_Surusu_Takip",
    "trade_in": "Takas_Firsatlari_Raporu",
    "warranty": "Garanti_Uzatma_Firsatlari",
    "processed": "Islem_Gecmisi_Arsivi",
    "untouched": "Islemsiz_Kayitlar_Raporu",
    "low_quality": "Kalitesiz_Veri_Raporu",
    "reminders": "Aktif_Hatirlaticilar",
    "logs": "Sistem_Güvenlik_Loglari",
    "general": "Genel_Analiz_Raporu",
}

# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------

# Whitespace as Python's str.strip() sees it, derived from str.isspace
# (all such characters lie below U+3001).
WS_CHARS = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
# A number as pandas.to_numeric accepts it (guard before try_cast): padded
# decimals, or a bare signed inf / infinity.
NUMERIC_PATTERN = r"(?i)^(\s*[+-]?(\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?\s*|[+-]?inf(inity)?)$"

# Default evaluation time for the bundled fixtures (newest order date).
FIXTURE_AS_OF = "2001-08-01 12:00:00"

# Date formats accepted when parsing loosely typed text, tried in order.
DATE_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "dd.MM.yyyy",
]

"""Fixed values.

Word lists, lookup tables, patterns and limits that decide results.  They are
data, not logic: changing one changes what a query returns.  In patterns ``\\b``
means the ASCII word boundary and ``\\s`` the full Unicode blank set;
``functions.text.pattern`` spells both out for Spark.
"""

# --- Sources, in load order: dataset directory -> source code ---------------
SOURCE_DIRS = {
    "extractor-behej-com": "behej",
    "extractor-ceskybeh-cz": "ceskybeh",
    "extractor-svetbehu-cz": "svetbehu",
}
DATASET_SUBDIR = "storage/datasets/default"
ORGANIZER_FIRST_SOURCE = "behej"

RAW_FIELDS = (
    "url", "title", "date", "city", "district", "region", "distance", "surface",
    "cup", "startTime", "startPlace", "registrationTime", "registrationPlace",
    "description", "website", "contact", "facebook", "photos", "rewards",
    "edition", "feeOnSite", "feePreRegistration",
)

# --- Text: diacritics the search function folds -----------------------------
CZECH_FROM = "áčďéěíňóřšťúůýžÁČĎÉĚÍŇÓŘŠŤÚŮÝŽäëïöüÄËÏÖÜ"
CZECH_TO = "acdeeinorstuuyzACDEEINORSTUUYZaeiouAEIOU"

# --- Month names in the genitive, January first -----------------------------
MONTHS_GENITIVE = (
    "ledna", "února", "března", "dubna", "května", "června",
    "července", "srpna", "září", "října", "listopadu", "prosince",
)

# --- Listing labels of two sites -> field -----------------------------------
TABLE_LABELS = {
    "den": "date",
    "místo": "location",
    "poháry": "cup",
    "délka hlavní tratě pro muže a ženy": "distance",
    "povrch": "surface",
    "popis trati": "description",
    "čas prezentace": "registrationTime",
    "místo prezentace": "registrationPlace",
    "čas startu": "startTime",
    "místo startu": "startPlace",
    "odměny": "rewards",
    "webové stránky": "website",
    "facebook": "facebook",
    "fotky": "photos",
    "kontakty": "contact",
    "ročník": "edition",
    "startovné na místě": "feeOnSite",
    "startovné předem": "feePreRegistration",
}
TERM_LABELS = {
    "datum konání": "date",
    "lokalita": "region",
    "místo konání": "venue",
    "délka (km)": "distance",
    "povrch": "surface",
    "pohár": "cup",
    "ročník": "edition",
    "místo a čas prezence": "registration",
    "místo a čas startu": "start",
    "odměny": "rewards",
    "kontakt": "contact",
    "startovné předem": "feePreRegistration",
    "startovné na místě": "feeOnSite",
}
# Icon class fragment -> field, first hit wins.
ICON_FIELDS = {
    "fa-calendar": "date",
    "fa-clock": "startTime",
    "fa-map-marker": "location",
    "fa-arrows-h": "distance",
    "fa-road": "raceType",
    "fa-user-circle": "organizer",
    "fa-globe": "website",
}
# Classes of the detail block of that layout, and of the parts of it whose paragraphs are read.
DETAIL_BLOCK = "race-detail"
DETAIL_TEXT = ("col-md-12", "text-muted")

# --- Distances --------------------------------------------------------------
NOT_A_DISTANCE = r"minut|hodin|hod\b"
RELAY = r"štafet"
KM_VALUE = r"(\d+[.,]?\d*)\s*(km|míle|mil)?"
KM_PER_MILE = 1.609
ROW_TOLERANCE_KM = 0.1
GROUP_TOLERANCE_KM = 0.5

# --- Surface -> terrain, first hit wins -------------------------------------
TERRAIN_KEYWORDS = (
    ("ocr", "obstacle"),
    ("překáž", "obstacle"),
    ("trail", "trail"),
    ("kros", "trail"),
    ("terén", "trail"),
    ("přírod", "trail"),
    ("vrchu", "trail"),
    ("dráha", "road"),
    ("silnic", "road"),
    ("asfalt", "road"),
    ("smíšen", "mixed"),
    ("štafet", "mixed"),
    ("jiný", "mixed"),
)
ROAD_WORDS = r"silnic|asfalt"
OFFROAD_WORDS = r"terén"
# Specificity order used when copies of a race disagree, least specific first.
TERRAIN_ORDER = ("road", "mixed", "cross", "trail", "obstacle")
TERRAIN_LABELS = {
    "road": "Silnice",
    "trail": "Trail",
    "cross": "Cross",
    "obstacle": "Překážky",
    "mixed": "Mix",
}

# --- Places -----------------------------------------------------------------
VENUE_PREFIX = (
    r"^(autokempink|areál|stadion|sportovní areál|ski areál|centrum|hotel"
    r"|restaurace|sportcentrum|koupaliště|park|hřiště|louka)\s+"
)
NUMBERED_CITY = r"^(Praha)\s+\d+$"
REGIONS = {
    "hlavní město praha": "Praha",
    "praha": "Praha",
    "středočeský kraj": "Středočeský",
    "středočeský": "Středočeský",
    "jihomoravský kraj": "Jihomoravský",
    "jihomoravský": "Jihomoravský",
    "moravskoslezský kraj": "Moravskoslezský",
    "moravskoslezský": "Moravskoslezský",
    "olomoucký kraj": "Olomoucký",
    "olomoucký": "Olomoucký",
    "olomouc": "Olomoucký",
    "liberecký kraj": "Liberecký",
    "liberecký": "Liberecký",
    "královéhradecký kraj": "Královéhradecký",
    "královéhradecký": "Královéhradecký",
    "plzeňský kraj": "Plzeňský",
    "plzeňský": "Plzeňský",
    "pardubický kraj": "Pardubický",
    "pardubický": "Pardubický",
    "ústecký kraj": "Ústecký",
    "ústecký": "Ústecký",
    "jihočeský kraj": "Jihočeský",
    "jihočeský": "Jihočeský",
    "karlovarský kraj": "Karlovarský",
    "karlovarský": "Karlovarský",
    "zlínský kraj": "Zlínský",
    "zlínský": "Zlínský",
    "vysočina": "Vysočina",
}
FOREIGN_REGIONS = (
    "slovensko", "rakousko", "španělsko", "itálie", "ostatní",
    "bratislavský kraj", "bratislavský",
    "žilinský", "žilinský kraj",
    "trnavský kraj", "trnavský",
    "trenčiansky kraj", "trenčiansky",
    "prešovský kraj", "prešovský",
    "košický kraj", "košický",
    "banskobystrický kraj", "banskobystrický",
    "nitriansky kraj", "nitriansky",
)
# name, latitude, longitude, region
CITY_COORDINATES = (
    ("Praha", 50.0755, 14.4378, "Praha"),
    ("Brno", 49.1951, 16.6068, "Jihomoravský"),
    ("Ostrava", 49.8209, 18.2625, "Moravskoslezský"),
    ("Plzeň", 49.7384, 13.3736, "Plzeňský"),
    ("Liberec", 50.7671, 15.0562, "Liberecký"),
    ("Olomouc", 49.5938, 17.2509, "Olomoucký"),
    ("České Budějovice", 48.9745, 14.4746, "Jihočeský"),
    ("Hradec Králové", 50.2104, 15.8252, "Královéhradecký"),
    ("Pardubice", 50.0343, 15.7812, "Pardubický"),
    ("Ústí nad Labem", 50.6607, 14.0323, "Ústecký"),
    ("Karlovy Vary", 50.2325, 12.8714, "Karlovarský"),
    ("Zlín", 49.2248, 17.6670, "Zlínský"),
    ("Jihlava", 49.3961, 15.5913, "Vysočina"),
    ("Kladno", 50.1487, 14.1031, "Středočeský"),
    ("Opava", 49.9388, 17.9029, "Moravskoslezský"),
    ("Frýdek-Místek", 49.6880, 18.3534, "Moravskoslezský"),
    ("Karviná", 49.8545, 18.5419, "Moravskoslezský"),
    ("Třebíč", 49.2148, 15.8815, "Vysočina"),
    ("Prostějov", 49.4715, 17.1134, "Olomoucký"),
    ("Příbram", 49.6855, 14.0109, "Středočeský"),
    ("Tábor", 49.4144, 14.6578, "Jihočeský"),
    ("Havířov", 49.7797, 18.4370, "Moravskoslezský"),
    ("Znojmo", 48.8555, 16.0488, "Jihomoravský"),
    ("Chomutov", 50.4593, 13.4178, "Ústecký"),
    ("Děčín", 50.7814, 14.2148, "Ústecký"),
    ("Mladá Boleslav", 50.4113, 14.9064, "Středočeský"),
    ("Jablonec nad Nisou", 50.7243, 15.1710, "Liberecký"),
    ("Přerov", 49.4559, 17.4513, "Olomoucký"),
    ("Beroun", 49.9638, 14.0722, "Středočeský"),
    ("Kolín", 50.0283, 15.2004, "Středočeský"),
)

# --- Fees -------------------------------------------------------------------
FREE_WORDS = ("dobrovolné", "neplatí", "zdarma")

# --- Row domains ------------------------------------------------------------
RACE_STATUSES = ("confirmed", "tentative", "cancelled")
EXTRACTION_STATUSES = ("pending", "extracted", "failed", "stale", "no_url", "complete")
VISIBLE_EXTRACTION = ("extracted", "complete")
QUEUED_EXTRACTION = ("pending", "failed")

# --- Entity resolution and search limits ------------------------------------
NAME_JACCARD = 0.6
FUZZY_THRESHOLD = 0.15
RADIUS_M = 40000.0
KM_TOLERANCE = 0.15
ULTRA_KM = 50
SEARCH_LIMIT = 100
HOME_LIMIT = 6
MAX_QUERY_CHARS = 200
SLUG_CHARS = 80
REPORT_GAP_SECONDS = 60

# --- Completeness: field, weight; the trail-only field is marked ------------
COMPLETENESS_WEIGHTS = (
    ("description", 15), ("time_start", 10), ("distances", 10), ("price_from", 10),
    ("website", 10), ("registration_url", 10), ("lat", 10), ("elevation_gain", 5),
    ("cover_url", 5), ("organizer", 5), ("capacity", 5),
)
TRAIL_ONLY_FIELD = "elevation_gain"
COMPLETENESS_LEVELS = (
    (75, "high", "Ověřené informace"),
    (40, "medium", "Základní informace"),
    (0, "low", "Málo informací"),
)

# --- Query parser, each list in order of precedence -------------------------
QUERY_TERRAINS = (
    (r"\b(?:trail|traily|trialy|trailovy|trailove|trailových|trailovych|teren|terén)\b", "trail"),
    (r"\b(?:cross|kros|prespolni|přespolní)\b", "cross"),
    (r"\b(?:prekazk|překážk|obstacle|spartan)\b", "obstacle"),
    (r"\b(?:silnic|asfalt|road|mestsk|městsk)\b", "road"),
)
QUERY_MONTHS = (
    (r"\b(?:leden|lednu|ledna)\b", 1),
    (r"\b(?:unor|unora|únor|února)\b", 2),
    (r"\b(?:brezen|breznu|brezna|březen|březnu|března)\b", 3),
    (r"\b(?:duben|dubnu|dubna)\b", 4),
    (r"\b(?:kveten|kvetnu|kvetna|květen|květnu|května)\b", 5),
    (r"\b(?:cerven|cervnu|cervna|červen|červnu|června)\b", 6),
    (r"\b(?:cervenec|cervenci|cervence|červenec|červenci|července)\b", 7),
    (r"\b(?:srpen|srpnu|srpna)\b", 8),
    (r"\b(?:zari|září)\b", 9),
    (r"\b(?:rijen|rijnu|rijna|říjen|říjnu|října)\b", 10),
    (r"\b(?:listopad|listopadu)\b", 11),
    (r"\b(?:prosinec|prosinci|prosince)\b", 12),
)
QUERY_CITIES = (
    (r"\b(?:praha|prahy|prahu|praze)\b", "Praha"),
    (r"\b(?:brno|brna|brnu|brne)\b", "Brno"),
    (r"\b(?:ostrava|ostravy|ostravu|ostrave)\b", "Ostrava"),
    (r"\b(?:plzen|plzne|plzni)\b", "Plzeň"),
    (r"\b(?:liberec|liberce|liberci)\b", "Liberec"),
    (r"\b(?:olomouc|olomouce|olomouci)\b", "Olomouc"),
    (r"\b(?:ceske budejovice|ceskych budejovic|ceskych budejovicich)\b", "České Budějovice"),
    (r"\b(?:hradec kralove|hradce kralove|hradci kralove)\b", "Hradec Králové"),
    (r"\b(?:pardubice|pardubic|pardubicich)\b", "Pardubice"),
    (r"\b(?:usti nad labem)\b", "Ústí nad Labem"),
    (r"\b(?:karlovy vary|karlovych var|karlovych varech)\b", "Karlovy Vary"),
    (r"\b(?:zlin|zlina|zlinu|zline)\b", "Zlín"),
    (r"\b(?:jihlava|jihlavy|jihlavu|jihlave)\b", "Jihlava"),
    (r"\b(?:kladno|kladna|kladnu|kladne)\b", "Kladno"),
    (r"\b(?:opava|opavy|opavu|opave)\b", "Opava"),
    (r"\b(?:frydek mistek|frydku mistku)\b", "Frýdek-Místek"),
    (r"\b(?:karvina|karvine)\b", "Karviná"),
    (r"\b(?:trebic|trebice|trebici)\b", "Třebíč"),
    (r"\b(?:prostejov|prostejova|prostejovu|prostejove)\b", "Prostějov"),
    (r"\b(?:pribram|pribrami)\b", "Příbram"),
)
QUERY_PROXIMITY = r"\b(?:okolo|okoli|pobliz|blizko|nedaleko)\b"
QUERY_ULTRA = r"\bultra\b"
QUERY_KM_NUMBER = r"\b(\d{1,3})\s*(?:km|k)\b"
QUERY_KM_WORDS = (
    (r"\bpulmaraton|pulmaratonu|pulku|pulka\b", 21),
    (r"\bmaraton|maratonu\b", 42),
    (r"\bdesitka|desitku|desitce\b", 10),
    (r"\bpetka|petku|petce\b", 5),
)
QUERY_FILLERS = r"\b(?:[vksuoz]|okoli|blizko|nedaleko|pobliz)\b"

# --- Labels shown to people -------------------------------------------------
NOT_STATED = "Neuvedeno"
FREE_LABEL = "Zdarma"
PLURAL_RACE = ("závod", "závody", "závodů")
WEEKDAYS = ("pondělí", "úterý", "středa", "čtvrtek", "pátek", "sobota", "neděle")

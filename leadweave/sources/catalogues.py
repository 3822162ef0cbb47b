"""Static dimensions of the market, and lookups in them.

All are tiny constants, so lookups broadcast them; where a substring decides, the first entry in order wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Regions as (code, English, French, Arabic name).
REGIONS = (
    (1, "Adrar", "Adrar", "أدرار"),
    (2, "Chlef", "Chlef", "الشلف"),
    (3, "Laghouat", "Laghouat", "الأغواط"),
    (4, "Oum El Bouaghi", "Oum El Bouaghi", "أم البواقي"),
    (5, "Batna", "Batna", "باتنة"),
    (6, "Béjaïa", "Béjaïa", "بجاية"),
    (7, "Biskra", "Biskra", "بسكرة"),
    (8, "Béchar", "Béchar", "بشار"),
    (9, "Blida", "Blida", "البليدة"),
    (10, "Bouira", "Bouira", "البويرة"),
    (11, "Tamanrasset", "Tamanrasset", "تمنراست"),
    (12, "Tébessa", "Tébessa", "تبسة"),
    (13, "Tlemcen", "Tlemcen", "تلمسان"),
    (14, "Tiaret", "Tiaret", "تيارت"),
    (15, "Tizi Ouzou", "Tizi Ouzou", "تيزي وزو"),
    (16, "Algiers", "Alger", "الجزائر"),
    (17, "Djelfa", "Djelfa", "الجلفة"),
    (18, "Jijel", "Jijel", "جيجل"),
    (19, "Sétif", "Sétif", "سطيف"),
    (20, "Saïda", "Saïda", "سعيدة"),
    (21, "Skikda", "Skikda", "سكيكدة"),
    (22, "Sidi Bel Abbès", "Sidi Bel Abbès", "سيدي بلعباس"),
    (23, "Annaba", "Annaba", "عنابة"),
    (24, "Guelma", "Guelma", "قالمة"),
    (25, "Constantine", "Constantine", "قسنطينة"),
    (26, "Médéa", "Médéa", "المدية"),
    (27, "Mostaganem", "Mostaganem", "مستغانم"),
    (28, "M'Sila", "M'Sila", "المسيلة"),
    (29, "Mascara", "Mascara", "معسكر"),
    (30, "Ouargla", "Ouargla", "ورقلة"),
    (31, "Oran", "Oran", "وهران"),
    (32, "El Bayadh", "El Bayadh", "البيض"),
    (33, "Illizi", "Illizi", "إليزي"),
    (34, "Bordj Bou Arréridj", "Bordj Bou Arréridj", "برج بوعريريج"),
    (35, "Boumerdès", "Boumerdès", "بومرداس"),
    (36, "El Tarf", "El Tarf", "الطارف"),
    (37, "Tindouf", "Tindouf", "تندوف"),
    (38, "Tissemsilt", "Tissemsilt", "تيسمسيلت"),
    (39, "El Oued", "El Oued", "الوادي"),
    (40, "Khenchela", "Khenchela", "خنشلة"),
    (41, "Souk Ahras", "Souk Ahras", "سوق أهراس"),
    (42, "Tipaza", "Tipaza", "تيبازة"),
    (43, "Mila", "Mila", "ميلة"),
    (44, "Aïn Defla", "Aïn Defla", "عين الدفلى"),
    (45, "Naâma", "Naâma", "النعامة"),
    (46, "Aïn Témouchent", "Aïn Témouchent", "عين تموشنت"),
    (47, "Ghardaïa", "Ghardaïa", "غرداية"),
    (48, "Relizane", "Relizane", "غليزان"),
    (49, "El M'Ghair", "El M'Ghair", "المغير"),
    (50, "El Meniaa", "El Meniaa", "المنيعة"),
    (51, "Ouled Djellal", "Ouled Djellal", "أولاد جلال"),
    (52, "Bordj Badji Mokhtar", "Bordj Badji Mokhtar", "برج باجي مختار"),
    (53, "Béni Abbès", "Béni Abbès", "بني عباس"),
    (54, "Timimoun", "Timimoun", "تيميمون"),
    (55, "Touggourt", "Touggourt", "تقرت"),
    (56, "Djanet", "Djanet", "جانت"),
    (57, "In Salah", "In Salah", "عين صالح"),
    (58, "In Guezzam", "In Guezzam", "عين قزام"),
)

# Industries as (key, label, average project value, expected digital gap, typical services).
INDUSTRIES = (
    ("restaurant", "Restaurant", 1800.0, 55, ("Online ordering system", "Table reservation widget", "Loyalty program platform")),
    ("pharmacy", "Pharmacy", 2500.0, 60, ("Inventory management system", "Online prescription refill", "Customer notification SMS gateway")),
    ("climatisation", "Climatisation & HVAC", 3000.0, 65, ("Field service dispatch app", "Customer portal for maintenance contracts", "Invoicing & quote generator")),
    ("menuiserie aluminium", "Aluminium Joinery", 3200.0, 70, ("Quote & order management system", "Customer design visualisation tool", "Production scheduling dashboard")),
    ("tolier", "Auto Body Repair", 2800.0, 65, ("Repair tracking portal", "Photo estimation tool", "Insurance claim automation")),
    ("supermarche", "Supermarket / Grocery", 3500.0, 50, ("POS integration", "Inventory & expiry tracking", "Home delivery ordering app")),
    ("logistics", "Logistics & Transport", 4500.0, 60, ("Fleet tracking dashboard", "Route optimisation engine", "Customer shipment tracking portal")),
    ("clinique", "Private Clinic", 5500.0, 55, ("Appointment booking system", "Electronic medical records", "Patient SMS reminders")),
    ("avocat", "Law Firm", 2800.0, 50, ("Case management system", "Client portal", "Document automation tool")),
    ("immobilier", "Real Estate Agency", 3500.0, 55, ("Property listing website", "CRM for agents", "Virtual tour integration")),
    ("automobile", "Car Dealer", 3200.0, 60, ("Inventory showcase website", "Financing calculator", "Lead capture CRM")),
    ("construction", "Construction & BTP", 4500.0, 65, ("Project management dashboard", "Quote & invoice generator", "Worksite progress tracker")),
    ("coiffure", "Hair Salon / Barber", 1200.0, 70, ("Online appointment booking", "Loyalty program", "Instagram-style portfolio")),
    ("boulangerie", "Bakery", 1500.0, 65, ("Pre-order app", "Loyalty stamps", "WhatsApp notification integration")),
)

# Services as (name, base value, priority, industries, pitch).
SERVICES = (
    ("Restaurant POS & Online Ordering", 1800.0, 8, ("restaurant", "boulangerie", "supermarche"), "Accept online orders 24/7 and reduce phone order errors."),
    ("Pharmacy Inventory & Refill System", 2500.0, 9, ("pharmacy", "clinique"), "Automate stock alerts and let customers refill online."),
    ("Field Service Dispatch App", 3000.0, 7, ("climatisation", "tolier", "construction"), "Dispatch technicians from your phone and track jobs in real time."),
    ("Quote & Order Management CRM", 2800.0, 7, ("menuiserie aluminium", "construction", "automobile"), "Generate professional quotes in 60 seconds and track every order."),
    ("Appointment Booking Widget", 900.0, 6, ("coiffure", "clinique", "avocat"), "Let clients book online and cut no-shows by 40% with SMS reminders."),
    ("E-commerce Website", 2200.0, 8, ("supermarche", "immobilier", "automobile"), "Sell online with a fast, mobile-first storefront."),
    ("Fleet Tracking Dashboard", 4500.0, 8, ("logistics", "construction"), "See every vehicle on a live map and optimise routes automatically."),
    ("Customer Loyalty & SMS Marketing", 1200.0, 5, ("restaurant", "coiffure", "boulangerie", "supermarche"), "Bring customers back with automated SMS offers and loyalty stamps."),
    ("WhatsApp Business Automation", 800.0, 6, ("restaurant", "pharmacy", "coiffure", "boulangerie"), "Auto-reply to customers on WhatsApp and capture leads 24/7."),
    ("Document & Case Management", 2800.0, 7, ("avocat", "immobilier"), "Find any file in seconds and never lose a deadline again."),
)

# Search terms as (term, French, Arabic, dialect variants).
DIALECT = (
    ("pharmacie", ("pharmacie", "officine", "parapharmacie", "laboratoire pharmacie"), ("صيدلية", "صيدليات", "شبه صيدلية"), ("farmasi", "farmaci", "صيدلية المناوبة", "صيدلية ليلية")),
    ("climatisation", ("climatisation", "frigoriste", "chauffage central", "climatiseurs", "ventilation"), ("تبريد وتكييف", "تكييف الهواء", "تركيب المكيفات"), ("klimatizasyon", "chuffaj central", "frigoriste", "كليماتيزور")),
    ("menuiserie aluminium", ("menuiserie aluminium", "fenêtres alu", "façadier aluminium", "extrusion aluminium"), ("نجارة الألمنيوم", "ورشة ألمنيوم", "مخزن ألمنيوم"), ("menuiserie aluminuim", "aluminium chabak", "المنيوم ميلة", "شبابيك ألمنيوم")),
    ("tolier", ("tolier carrossier", "carrosserie automobile", "peinture automobile", "débosselage"), ("دهان السيارات", "تصليح هيكل السيارات", "سمكرة السيارات"), ("tolri", "tolri tomobila", "sabgha tomobil", "طولري طوموبيلات")),
    ("supermarche", ("supermarché", "supérette", "alimentation générale", "grossiste alimentation"), ("سوبرماركت", "محل مواد غذائية", "بيع المواد الغذائية بالجملة"), ("superette", "hanout mida", "grossiste", "حانوت بيع المواد الغذائية")),
    ("restaurant", ("restaurant", "snack", "fast-food", "traiteur", "pizzeria"), ("مطعم", "وجبات سريعة", "بيتزا"), ("resto", "snack", "fast food", "مطعم")),
    ("logistics", ("logistique", "transport de marchandises", "transit", "fret", "commissionnaire"), ("النقل واللوجستيك", "شحن البضائع", "ترانزيت"), ("logistique", "transport marchandises", "ترانسيت", "شحن بضاعة")),
    ("clinique", ("clinique", "cabinet médical", "centre de santé", "laboratoire d'analyses"), ("عيادة", "مركز صحي", "مختبر تحاليل"), ("klinique", "cabinet toubib", "مرقص صحي")),
    ("avocat", ("avocat", "cabinet juridique", "conseil juridique", "huissier"), ("محامي", "مكتب محاماة", "استشارات قانونية"), ("avocat", "cabinet juridique", "محامي")),
    ("immobilier", ("agence immobilière", "promoteur immobilier", "location", "vente immobilière"), ("وكالة عقارية", "مروج عقاري", "كراء وبيع"), ("agence immobilire", "immobilier", "promotion immobilière")),
    ("automobile", ("concessionnaire automobile", "garage automobile", "pièces détachées", "mécanique auto"), ("وكيل سيارات", "كراج سيارات", "قطع غيار"), ("concessionnaire auto", "garage", "pièces détachées", "ميكونيسيان")),
    ("construction", ("entreprise BTP", "génie civil", "travaux publics", "maçonnerie", "béton armé"), ("مقاولة بناء", "أشغال عمومية", "بناء مدني"), ("entreprise BTP", "travaux", "maçonnerie", "بي تي بي")),
    ("coiffure", ("salon de coiffure", "barbier", "institut de beauté"), ("صالون حلاقة", "حلاق", "مركز تجميل"), ("salon coiffure", "barbier", "coiffeur", "صالون حلاقة")),
    ("boulangerie", ("boulangerie", "pâtisserie", "viennoiserie"), ("مخبزة", "حلويات"), ("boulangerie", "pâtisserie", "خباز")),
)

# Map tags and the industry that they stand for, in order of precedence.
MAP_TAGS = (
    ("amenity=pharmacy", "Pharmacy"),
    ("amenity=clinic", "Clinic"),
    ("amenity=hospital", "Clinic"),
    ("amenity=doctors", "Clinic"),
    ("amenity=dentist", "Clinic"),
    ("amenity=restaurant", "Restaurant"),
    ("amenity=cafe", "Restaurant"),
    ("amenity=fast_food", "Restaurant"),
    ("amenity=bar", "Restaurant"),
    ("amenity=bank", "Bank"),
    ("amenity=fuel", "Fuel Station"),
    ("amenity=car_repair", "Auto Repair"),
    ("shop=supermarket", "Supermarket"),
    ("shop=convenience", "Supermarket"),
    ("shop=bakery", "Bakery"),
    ("shop=hairdresser", "Hair Salon"),
    ("shop=car", "Car Dealer"),
    ("shop=car_repair", "Auto Repair"),
    ("office=company", "Office"),
    ("office=lawyer", "Law Firm"),
    ("office=accountant", "Accounting"),
    ("office=real_estate_agent", "Real Estate Agency"),
    ("craft=carpenter", "Carpentry"),
    ("craft=electrician", "Electrician"),
    ("craft=plumber", "Plumber"),
)

# Words of a query and the map tags that they ask for.
QUERY_TAGS = (
    ("pharmacie", ("amenity=pharmacy",)),
    ("pharmacy", ("amenity=pharmacy",)),
    ("صيدلية", ("amenity=pharmacy",)),
    ("officine", ("amenity=pharmacy",)),
    ("clinic", ("amenity=clinic", "amenity=hospital", "amenity=doctors")),
    ("clinique", ("amenity=clinic", "amenity=hospital", "amenity=doctors")),
    ("hospital", ("amenity=hospital",)),
    ("hopital", ("amenity=hospital",)),
    ("مستشفى", ("amenity=hospital",)),
    ("عيادة", ("amenity=clinic", "amenity=doctors")),
    ("doctors", ("amenity=doctors",)),
    ("dentist", ("amenity=dentist",)),
    ("dentiste", ("amenity=dentist",)),
    ("restaurant", ("amenity=restaurant", "amenity=fast_food")),
    ("resto", ("amenity=restaurant", "amenity=fast_food")),
    ("مطعم", ("amenity=restaurant", "amenity=fast_food")),
    ("pizzeria", ("amenity=restaurant",)),
    ("cafe", ("amenity=cafe",)),
    ("مقهى", ("amenity=cafe",)),
    ("bakery", ("shop=bakery",)),
    ("boulangerie", ("shop=bakery",)),
    ("مخبزة", ("shop=bakery",)),
    ("supermarket", ("shop=supermarket",)),
    ("supermarche", ("shop=supermarket",)),
    ("supérette", ("shop=convenience", "shop=supermarket")),
    ("سوبرماركت", ("shop=supermarket",)),
    ("hairdresser", ("shop=hairdresser",)),
    ("coiffure", ("shop=hairdresser",)),
    ("حلاق", ("shop=hairdresser",)),
    ("lawyer", ("office=lawyer",)),
    ("avocat", ("office=lawyer",)),
    ("محامي", ("office=lawyer",)),
    ("real_estate", ("office=real_estate_agent",)),
    ("immobilier", ("office=real_estate_agent",)),
    ("عقارات", ("office=real_estate_agent",)),
    ("car_repair", ("amenity=car_repair", "shop=car_repair")),
    ("mecanicien", ("amenity=car_repair", "shop=car_repair")),
    ("garage", ("amenity=car_repair", "shop=car_repair")),
    ("تصليح سيارات", ("amenity=car_repair",)),
    ("plumber", ("craft=plumber",)),
    ("plombier", ("craft=plumber",)),
    ("ترصيص", ("craft=plumber",)),
)

# Words that ask for any shop.
SHOP_WORDS = ("shop", "store", "magasin", "hanout", "محل", "دكان")

def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGIONS, "code int, name_en string, name_fr string, name_ar string")


def industries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INDUSTRIES, "key string, label string, average_project_value_usd double, expected_digital_gap int, typical_services array<string>")


def services(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *s) for i, s in enumerate(SERVICES)], "ord int, name string, base_value_usd double, priority int, relevant_industries array<string>, pitch_angle string")


def dialect(spark: SparkSession) -> DataFrame:
    """(ord, term, variants): all variants of a term in order."""
    return spark.createDataFrame([(i, t, [*fr, *ar, *da]) for i, (t, fr, ar, da) in enumerate(DIALECT)], "ord int, term string, variants array<string>")


def region_names(spark: SparkSession) -> DataFrame:
    return regions(spark).select("code", F.col("name_en").alias("name")).orderBy("code")


def join_region(df: DataFrame, name: Column) -> DataFrame:
    """Adds ``region`` (a row of regions, null if none has the name): English and French names ignore case, Arabic ones don't."""
    dim = regions(df.sparkSession)
    keys = dim.select(F.struct(*dim.columns).alias("region"), F.explode(F.array_distinct(F.array(F.lower("name_en"), F.lower("name_fr")))).alias("region_key"))
    keys = keys.unionByName(dim.select(F.struct(*dim.columns).alias("region"), F.col("name_ar").alias("region_key")))
    return df.join(F.broadcast(keys), F.lower(F.trim(name)) == F.col("region_key"), "left").drop("region_key")


def join_industry(df: DataFrame, key: Column) -> DataFrame:
    """Adds ``industry_meta``: the industry with this key or label, case aside."""
    dim = industries(df.sparkSession)
    keys = dim.select(F.struct(*dim.columns).alias("industry_meta"), F.explode(F.array_distinct(F.array("key", F.lower("label")))).alias("industry_key"))
    return df.join(F.broadcast(keys), F.lower(F.trim(key)) == F.col("industry_key"), "left").drop("industry_key")


def dialect_variants(query: Column) -> Column:
    """Variants of the first term that holds the query, itself or in a variant; null if none does."""
    needle = F.lower(F.trim(query))
    out = None
    for term, *lists in DIALECT:
        every = [v for part in lists for v in part]
        hit = F.lit(term).contains(needle) | F.exists(F.array(*[F.lit(v.lower()) for v in every]), lambda v: v.contains(needle))
        got = F.array(*[F.lit(v) for v in every])
        out = F.when(hit, got) if out is None else out.when(hit, got)
    return F.when(F.coalesce(needle, F.lit("")) != "", out)


def map_filters(query: Column) -> Column:
    """Up to five map tags for a query: by words in either direction, then tags and industries that hold it, then any shop."""
    q = F.lower(F.trim(query))
    none = F.array().cast("array<string>")
    asked = [F.when(q.contains(w) | F.lit(w).contains(q), F.array(*[F.lit(t) for t in tags])).otherwise(none) for w, tags in QUERY_TAGS]
    held = [F.when(F.lit(t.lower()).contains(q) | F.lit(i.lower()).contains(q), F.array(F.lit(t))).otherwise(none) for t, i in MAP_TAGS]
    found = F.array_distinct(F.flatten(F.array(*asked, *held)))
    shop = F.exists(F.array(*[F.lit(w) for w in SHOP_WORDS]), lambda w: q.contains(w))
    return F.slice(F.when((F.size(found) == 0) & shop, F.array(F.lit("shop"))).otherwise(found), 1, 5)


def map_industry(tags: Column) -> Column:
    """Industry of a map element from its tags (a map), by the order of MAP_TAGS."""
    cases = [F.when(F.element_at(tags, t.partition("=")[0]) == t.partition("=")[2], i) for t, i in MAP_TAGS]
    return F.coalesce(*cases)


def map_query(query: Column, region: Column) -> Column:
    """The map service's query text for a query in a region; null without a region or without tags.

    ``region`` is the French name where the region is known, else as given."""
    filters = map_filters(query)
    place = F.concat(F.lit('area["name"~"^'), F.replace(region, F.lit('"'), F.lit('\\"')), F.lit('$",i]->.searchArea;'))
    parts = F.flatten(F.transform(filters, lambda t: F.array(F.concat(F.lit("node["), t, F.lit("](area.searchArea);")), F.concat(F.lit("way["), t, F.lit("](area.searchArea);")))))
    return F.when((F.size(filters) > 0) & (region != ""), F.concat(F.lit("[out:json];"), place, F.lit("("), F.array_join(parts, ""), F.lit(");out center;")))

"""Word lists, tables and patterns that results depend on. Nothing here is logic."""

# Severity by crime type.
SEVERITY = {
    "murder": 1.0, "assault": 0.8, "robbery": 0.8, "weapons": 0.9, "burglary": 0.6, "drug_offence": 0.5, "vehicle_crime": 0.4,
    "criminal_damage": 0.4, "theft": 0.3, "fraud": 0.4, "public_order": 0.3, "antisocial": 0.2, "sexual_offence": 0.9,
}
BOOST_WORDS = "murder kill dead death gun firearm bomb stab armed".split()
THREAT_WORDS = "threat kill attack bomb shoot stab stabbed shot killed fire destroy retaliate hurt harm murder execute".split()
NEGATIVE_WORDS = (
    "violent attack assault murder stab shoot kill threaten harm hurt damage destroy break steal rob threat aggressive dangerous weapon "
    "crime criminal drug illegal forced smashed broken stolen mugged robbed stabbed shot fired bombed looted ransacked vandalised "
    "vandalized terror suspect offender perpetrator abused victim wounded injured dead death beaten coerced trafficked"
).split()
POSITIVE_WORDS = (
    "helped prevented stopped caught arrested resolved recovered safe clear peaceful secured protected rescued apprehended convicted sentenced"
).split()
# Keywords and their weights by crime type.
KEYWORDS = {
    "assault": {"attack": 3, "assault": 3, "hit": 2, "punch": 2, "kick": 2, "stab": 3, "beat": 2, "fight": 2, "violence": 2, "victim": 1},
    "robbery": {"robbery": 3, "robbed": 3, "mugged": 3, "took": 1, "stole": 2, "threatened": 2, "demanded": 2, "weapon": 2},
    "burglary": {"burglar": 3, "burglary": 3, "broke": 2, "entry": 2, "house": 1, "home": 1, "stolen": 2, "ransacked": 2, "forced": 2},
    "theft": {"theft": 3, "stolen": 3, "pickpocket": 3, "shoplifting": 3, "took": 1, "missing": 1},
    "vehicle_crime": {"car": 1, "vehicle": 1, "stolen": 2, "vandalised": 2, "break-in": 3, "window": 1, "tyre": 1},
    "drug_offence": {"drugs": 3, "heroin": 3, "cocaine": 3, "cannabis": 3, "dealing": 3, "possession": 2},
    "criminal_damage": {"damage": 2, "vandalism": 3, "graffiti": 2, "smashed": 2, "destroyed": 2, "fire": 1},
    "public_order": {"disorder": 2, "disturbance": 2, "fighting": 2, "drunk": 2, "threatening": 2},
    "weapons": {"knife": 3, "gun": 3, "firearm": 3, "weapon": 2, "blade": 3, "armed": 3},
    "fraud": {"fraud": 3, "scam": 3, "fake": 2, "impersonation": 2, "identity": 2, "phishing": 3},
    "antisocial": {"antisocial": 3, "nuisance": 2, "noise": 2, "harassment": 2, "loitering": 2, "abusive": 2},
    "murder": {"murder": 3, "killed": 3, "dead": 2, "homicide": 3, "manslaughter": 3, "death": 2, "victim": 1, "body": 1, "fatal": 2},
    "sexual_offence": {"rape": 3, "sexual": 3, "indecent": 3, "assault": 1, "touching": 2, "exposure": 2},
}
# Modus-operandi words by label; the first label with a word in the text counts.
ENTRY = {
    "forced_entry": "smashed|broke|forced|pried|kicked|jimmied|broken",
    "unlocked": "unlocked|open|unsecured|left open",
    "deception": "pretended|posed as|impersonated|tricked|deceived",
    "tailgating": "tailgated|followed|piggybacked",
    "window": "window",
}
TARGET = {
    "residential": "house|home|flat|apartment|unit|residence|dwelling|property",
    "commercial": "shop|store|office|warehouse|factory|business|premises",
    "vehicle": "car|vehicle|truck|van|motorcycle|bike|auto",
    "person": "person|pedestrian|victim|woman|man|child|individual",
}
TIME_OF_DAY = {
    "early_morning": r"1am|2am|3am|4am|5am|early morning|overnight|before dawn|0[0-5]:\d{2}",
    "morning": r"6am|7am|8am|9am|10am|11am|morning|0[6-9]:\d{2}|1[01]:\d{2}",
    "afternoon": r"12pm|1pm|2pm|3pm|4pm|5pm|afternoon|midday|1[2-7]:\d{2}",
    "evening": r"6pm|7pm|8pm|9pm|evening|dusk|sunset|1[89]:\d{2}|2[01]:\d{2}",
    "night": r"10pm|11pm|midnight|night|dark|late night|2[23]:\d{2}",
}
WEAPON = {
    "firearm": "gun|pistol|rifle|firearm|shotgun|revolver|handgun",
    "knife": "knife|blade|stabbed|slashed|cut|machete|sword",
    "blunt": "bat|hammer|club|pipe|rod|crowbar|wrench",
    "other": "acid|explosive|taser|spray|chemical|fire",
}
VICTIM = {
    "elderly": "elderly|old|senior|pensioner|retired|aged",
    "child": "child|children|minor|juvenile|teenager|youth",
    "female": "woman|female|girl|lady|her|she",
    "male": "man|male|boy|gentleman|him|he",
    "business": "shop|business|owner|manager|staff|employee",
    "vulnerable": "vulnerable|disabled|homeless|isolated",
}
PRECAUTION = {
    "gloves": "gloves|wore gloves|wearing gloves",
    "mask": "mask|masked|balaclava|disguise",
    "balaclava": "balaclava|ski mask|face covering",
}
ITEMS = (
    "cash|jewellery|jewelry|phone|laptop|wallet|keys|handbag|watch|electronics|tools|purse|bag|card|bicycle|bike|tablet|passport|documents|"
    "clothing|jewels|necklace|ring|camera"
)
SOLO = "alone|solo|lone|single|by himself|by herself"
GROUP = "group|gang|multiple|several|two|three|four|pair"
# Evidence types: likelihood ratio, reliability.
EVIDENCE = {
    "eyewitness_identification_ideal": (4.0, 0.70),
    "eyewitness_identification_poor": (1.5, 0.40),
    "fingerprint_match_10pt": (1e6, 0.99),
    "fingerprint_match_8pt": (1e4, 0.97),
    "dna_match_full_profile": (1e9, 0.999),
    "dna_match_partial": (1e4, 0.95),
    "cctv_clear_face": (50.0, 0.85),
    "cctv_partial": (5.0, 0.60),
    "phone_records_at_scene": (200.0, 0.95),
    "alibi_strong": (0.05, 0.80),
    "alibi_weak": (0.50, 0.50),
    "modus_operandi_match_high": (8.0, 0.75),
    "modus_operandi_match_moderate": (3.0, 0.65),
    "geographic_profile_in_peak_zone": (4.5, 0.70),
    "prior_conviction_same_type": (3.0, 0.90),
    "network_link_direct": (2.0, 0.70),
    "vehicle_at_scene": (15.0, 0.80),
    "tool_mark_match": (100.0, 0.85),
    "shoe_impression_match": (200.0, 0.88),
    "glass_fragments_match": (50.0, 0.80),
    "fibre_transfer_match": (30.0, 0.75),
    "blood_type_match": (3.0, 0.60),
    "social_media_location": (20.0, 0.75),
    "digital_device_at_scene": (150.0, 0.90),
    "informant_tip_reliable": (5.0, 0.60),
    "informant_tip_unreliable": (1.5, 0.30),
    "no_alibi": (1.2, 0.40),
}
# Reliability of sources; any other counts 0.5.
RELIABILITY = {
    "uk_police_v1": 0.90, "uk_police": 0.90, "open_meteo": 0.85, "weather": 0.85, "csv_import": 0.60, "csv": 0.60, "chicago_pd": 0.85,
    "nypd": 0.85, "lapd": 0.80, "abs_australia": 0.80, "test": 0.50, "cincinnati": 0.75, "sfpd": 0.80, "manual": 0.40,
}
# Police category to crime type.
POLICE_CATEGORIES = {
    "burglary": "burglary", "robbery": "robbery", "violent-crime": "assault", "vehicle-crime": "vehicle_crime", "drugs": "drug_offence",
    "anti-social-behaviour": "antisocial", "theft-from-the-person": "theft", "other-theft": "theft", "shoplifting": "theft",
    "criminal-damage-arson": "criminal_damage", "public-order": "public_order", "possession-of-weapons": "weapons",
}
# Near-repeat bands by crime type: metres, days, risk multiplier; and for any other type.
NEAR_REPEAT = {
    "burglary": (200.0, 14.0, 4.5), "robbery": (400.0, 7.0, 3.2), "assault": (150.0, 3.0, 2.8), "vehicle_crime": (300.0, 21.0, 3.0),
    "drug_offence": (100.0, 7.0, 2.1),
}
NEAR_REPEAT_DEFAULT = (300.0, 14.0, 3.0)
# Date formats, in the order in which they are tried.
DATE_FORMATS = [
    "MM/dd/yyyy hh:mm:ss a", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy", "yyyy/MM/dd hh:mm:ss a", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd",
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy-MM", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "M/d/yyyy H:mm",
]
# Targets of the benchmark report; for brier lower is better.
TARGETS = {"pai_5": 6.0, "pai_10": 4.5, "pai_20": 3.0, "pei_10": 0.6, "ser": 0.4, "auc_roc": 0.85, "brier": 0.10}

"""Values that must equal the data they are compared with: words, labels, limits."""

# English query -> Greek search words (a repeated key keeps its last value).
EN_TO_GR = {
    "chicken": "κοτοπουλο", "chicken breast": "κοτοπουλο στηθος", "turkey": "γαλοπουλα",
    "beef": "μοσχαρι", "pork": "χοιρινο", "lamb": "αρνι", "fish": "ψαρι", "salmon": "σολομος",
    "tuna": "τονος", "shrimp": "γαριδα", "egg": "αυγο", "eggs": "αυγα", "bacon": "μπεικον",
    "ham": "ζαμπον", "sausage": "λουκανικο",
    "milk": "γαλα", "cheese": "τυρι", "feta": "φετα", "yogurt": "γιαουρτι", "yoghurt": "γιαουρτι",
    "butter": "βουτυρο", "cream": "κρεμα", "sour cream": "ξινη κρεμα",
    "tomato": "ντοματα", "onion": "κρεμμυδι", "garlic": "σκορδο", "potato": "πατατα",
    "carrot": "καροτο", "pepper": "πιπερι", "cucumber": "αγγουρι", "lettuce": "μαρουλι",
    "spinach": "σπανακι", "broccoli": "μπροκολο", "zucchini": "κολοκυθακι",
    "eggplant": "μελιτζανα", "mushroom": "μανιταρι", "corn": "καλαμποκι",
    "pea": "μπιζελι", "bean": "φασολι", "beans": "φασολια", "lentils": "φακες", "lentil": "φακες",
    "chickpea": "ρεβιθι", "chickpeas": "ρεβιθια",
    "apple": "μηλο", "orange": "πορτοκαλι", "banana": "μπανανα", "grape": "σταφυλι",
    "lemon": "λεμονι", "strawberry": "φραουλα", "watermelon": "καρπουζι", "peach": "ροδακινο",
    "bread": "ψωμι", "rice": "ρυζι", "pasta": "ζυμαρικα", "spaghetti": "σπαγγετι",
    "flour": "αλευρι", "oats": "βρωμη", "oat": "βρωμη", "cereal": "δημητριακα",
    "oil": "λαδι", "olive oil": "ελαιολαδο", "sunflower oil": "ηλιελαιο",
    "salt": "αλατι", "sugar": "ζαχαρη", "honey": "μελι", "vinegar": "ξιδι",
    "ketchup": "κετσαπ", "mustard": "μουσταρδα", "mayonnaise": "μαγιονεζα",
    "water": "νερο", "juice": "χυμος", "coffee": "καφες", "tea": "τσαι", "beer": "μπυρα", "wine": "κρασι",
    "chocolate": "σοκολατα", "cookie": "μπισκοτο", "chips": "πατατακια", "nuts": "ξηροι καρποι",
    "almond": "αμυγδαλο", "almonds": "αμυγδαλα", "walnut": "καρυδι", "walnuts": "καρυδια",
}

# Latin letter pairs, applied in this order, then single letters.
GREEKLISH_PAIRS = [
    ("th", "θ"), ("ou", "ου"), ("ks", "ξ"), ("ps", "ψ"), ("ch", "χ"), ("ph", "φ"), ("gh", "γ"),
    ("ai", "αι"), ("ei", "ει"), ("oi", "οι"), ("au", "αυ"), ("eu", "ευ"),
]
GREEKLISH_LETTERS = ("abgdezhiklmnxoprstufywvcq", "αβγδεζηικλμνξοπρστυφυωβκκ")

# Words that mark pet food, in names and in queries, and flavour words.
PET_NAME_WORDS = [
    "γατα", "γατος", "γατων", "γατας", "σκυλος", "σκυλου", "σκυλων", "κατοικιδι", "ζωοτρ", "γατοτρ",
    "σκυλοτρ", "petshop", "pet shop",
]
PET_QUERY_WORDS = ["γατα", "γατ ", "σκυλ", "κατοικιδι", "ζωοτρ"]
FLAVOUR_WORDS = ["με γευση", "με αρωμα", "γευση", "αρωμα"]

# Quantity units stripped from the front of an ingredient.
QUANTITY_UNITS = [
    "γρ", "gr", "g", "κιλ", "kg", "ml", "lt", "λίτρ", "τεμ", "τεμάχ", "κ\\.σ\\.", "κ\\.γ\\.", "φλ\\.?",
    "μεγάλ[οα]", "μεσαί[οα]",
]

# Marketing phrases that make a recipe line noise (accents removed).
NOISE_PHRASES = [
    "gymbeam", "μπορει να σας ενδιαφερουν", "μπορει να σας ενδιαφερει", "αυτα τα προιοντα", "δειτε επισης",
    "related products", "bestseller", "σκονη πρωτεινης",
]

# Words that head the ingredient and the instruction section of a page.
INGREDIENT_MARKERS = ["Θα χρειαστούμε:", "Θα χρειαστούμε", "Υλικά:", "Υλικά", "Συστατικά:"]
INSTRUCTION_MARKERS = ["Οδηγίες:", "Οδηγίες", "Εκτέλεση:", "Εκτέλεση", "Παρασκευή:", "Παρασκευή"]

# Recipe category by word pattern, first hit wins.
CATEGORY_PATTERNS = [
    ("Πρωινό", "πρωιν|breakfast"), ("Σαλάτες", "σαλατ"), ("Σούπες", "σουπ"), ("Σνακ", "σνακ|snack"),
    ("Επιδόρπια", "επιδορπ|γλυκ|dessert|κεικ|cake|μπισκοτ|τουρτ|ταρτ|tart|brownie|cheesecake"),
    ("Συνοδευτικά", "συνοδευτ"), ("Ροφήματα", "ροφημ|smoothie|shake|drink"),
]
# Recipe category by dish type, first hit wins.
CATEGORY_DISH_TYPES = [
    ("Πρωινό", ["breakfast", "morning meal"]), ("Σαλάτες", ["salad"]), ("Σούπες", ["soup"]),
    ("Σνακ", ["snack", "appetizer", "antipasto", "starter"]), ("Επιδόρπια", ["dessert", "sweet"]),
    ("Συνοδευτικά", ["side dish"]), ("Ροφήματα", ["beverage", "drink"]),
]
DEFAULT_CATEGORY = "Κυρίως"

# Cuisine labels.
CUISINES = {
    "greek": "Ελληνική", "mediterranean": "Μεσογειακή", "italian": "Ιταλική", "mexican": "Μεξικάνικη",
    "chinese": "Κινέζικη", "japanese": "Ιαπωνική", "indian": "Ινδική", "thai": "Ταϊλανδέζικη",
    "french": "Γαλλική", "american": "Αμερικάνικη", "spanish": "Ισπανική", "turkish": "Τουρκική",
    "middle eastern": "Μέση Ανατολή", "korean": "Κορεάτικη", "vietnamese": "Βιετναμέζικη",
    "african": "Αφρικάνικη", "british": "Βρετανική", "german": "Γερμανική",
}
DEFAULT_CUISINE = "Διεθνής"

# Meal category and area labels.
MEAL_CATEGORIES = {
    "Beef": "Μοσχάρι", "Chicken": "Κοτόπουλο", "Dessert": "Γλυκό", "Lamb": "Αρνί", "Pork": "Χοιρινό",
    "Seafood": "Θαλασσινά", "Vegetarian": "Χορτοφαγικό", "Pasta": "Ζυμαρικά", "Side": "Συνοδευτικό",
    "Starter": "Ορεκτικό", "Vegan": "Vegan", "Miscellaneous": "Διάφορα", "Breakfast": "Πρωινό",
    "Goat": "Κατσίκι",
}
MEAL_AREAS = {
    "Greek": "Ελληνική", "Italian": "Ιταλική", "Spanish": "Ισπανική", "Turkish": "Τουρκική",
    "Moroccan": "Μαροκινή", "French": "Γαλλική", "British": "Βρετανική", "American": "Αμερικανική",
    "Chinese": "Κινέζικη", "Indian": "Ινδική", "Japanese": "Ιαπωνική", "Mexican": "Μεξικανική",
    "Thai": "Ταϊλανδέζικη", "Vietnamese": "Βιετναμέζικη", "Jamaican": "Τζαμαϊκανή", "Croatian": "Κροατική",
    "Dutch": "Ολλανδική", "Egyptian": "Αιγυπτιακή", "Filipino": "Φιλιππινέζικη", "Irish": "Ιρλανδική",
    "Kenyan": "Κενυατική", "Malaysian": "Μαλαισιανή", "Polish": "Πολωνική", "Portuguese": "Πορτογαλική",
    "Russian": "Ρωσική", "Tunisian": "Τυνησιακή", "Unknown": "Άγνωστη",
}

# Difficulty labels.
EASY, MEDIUM, HARD = "Εύκολη", "Μέτρια", "Δύσκολη"

# Nutrient codes of the nutrition sources -> field.
NUTRIENT_FIELDS_BY_ID = {
    1008: "kcal", 1003: "proteins", 1004: "fat", 1258: "saturated", 1005: "carbs", 2000: "sugars",
    1079: "fiber", 1093: "sodium", 1253: "cholesterol",
}
NUTRIENT_FIELDS_BY_CODE = [
    ("ENERC_KCAL", "kcal"), ("FAT", "fat"), ("FASAT", "saturated"), ("CHOCDF", "carbs"), ("SUGAR", "sugars"),
    ("SUGARFR", "sugars"), ("FIBTG", "fiber"), ("PROCNT", "proteins"), ("NA", "sodium"), ("CHOLE", "cholesterol"),
]
SCORED_NUTRIENTS = ["kcal", "fat", "proteins", "carbs", "sugars", "fiber"]

# Meal-plan feedback reasons.
FEEDBACK_REASONS = ["different_recipes", "lighter", "cheaper", "faster", "more_variety", "other"]

# Admission limits, (hits, window in seconds).
RATE_LIMITS = {"api": (200, 900), "sign_in": (10, 900), "estimates": (15, 3600), "plate_scan": (10, 60)}
PROVIDER_LIMITS = {"first": (50, 60), "second": (14, 60), "third": (28, 60), "fourth": (50, 60)}

# Domain part of a listing url -> (store label, store id), first hit wins.
STORE_DOMAINS = [
    ("ab.gr", "ΑΒ Βασιλόπουλος", "ab"), ("sklavenitis.gr", "Σκλαβενίτης", "sklavenitis"),
    ("mymarket.gr", "MyMarket", "mymarket"), ("masoutis.gr", "Μασούτης", "masoutis"),
    ("kritikos-sm.gr", "Κρητικός", "kritikos"), ("galaxias.shop", "Γαλαξίας", "galaxias"),
    ("market-in.gr", "Market In", "marketin"), ("lidl-hellas.gr", "Lidl", "lidl"),
]

# Plate-scan defaults.
UNKNOWN_FOOD, PLATE_EMOJI, NO_PORTION = "Άγνωστο", "🍽️", "—"
DEFAULT_MEAL_TYPE = "κυρίως γεύμα"
DEFAULT_TIP = "Μια πιο καθαρή φωτογραφία από κοντά βοηθά το AI να εκτιμά καλύτερα τις μερίδες."
DEFAULT_SNACKS = ("Φρούτο εποχής", "Χούφτα ξηρούς καρπούς")

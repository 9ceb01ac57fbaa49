"""Default vocabularies and constants.

Everything here is a parameter default.  Larger vocabularies (the ingredient
catalog, the general category rules) are tables handed to the operators.
"""

from __future__ import annotations


def _lines(text: str) -> tuple[str, ...]:
    return tuple(p.strip() for p in text.replace("\n", ",").split(",") if p.strip())


def _table(text: str) -> dict[str, tuple[str, ...]]:
    out = {}
    for line in text.strip().splitlines():
        name, values = line.split(":", 1)
        out[name.strip()] = _lines(values)
    return out


# ---- fixed values: ratings and candidates -------------------------------
INTERACTION_WEIGHTS = {
    "viewed": 1.5,
    "started": 3.5,
    "liked": 4.5,
    "saved": 5.0,
    "completed": 5.0,
    "dismissed": 0.0,
}
UNKNOWN_INTERACTION_WEIGHT = 1.0
KEPT_TYPES = ("liked", "saved", "save")
POSITIVE_TYPES = ("liked", "saved", "started", "completed")
HISTORICAL_PREFIX = "hist_"
HISTORICAL_MIN_RATING = 4.0
CANDIDATE_LIMIT = 500
PREDICTION_LIMIT = 120
ROW_SIZE = 6
COOKBOOK_LIMIT = 5
TRENDING_DAYS = 7
TRENDING_LIMIT = 200
ONLINE_MAX_WEIGHT = 0.35
ONLINE_FULL_STRENGTH = 5.0
ONLINE_DELTA_LIMIT = 1.0

# ---- fixed values: catalog rules -----------------------------------------
NUTRITION_SLOTS = ("calories", "fat", "sugar", "sodium", "protein", "sat_fat", "carbs")
QUICK_MINUTES = 30
HEALTHY_CALORIES = 400.0
HEALTHY_FAT = 20.0
FLAVOR_KEYWORDS = _lines("""
chili, chilli, chile, ginger, lemongrass, lemon, lime, curry, harissa, sriracha,
wasabi, tabasco, paprika, cinnamon, cardamom, cumin, turmeric, saffron, cilantro,
coriander, basil, mint, soy sauce, fish sauce, miso, vinegar
""")
FLAVOR_SEEDS = _lines("""
harissa, sriracha, gochujang, sambal, kimchi, fish sauce, miso, wasabi, tabasco,
curry paste, chili paste, red curry, green curry, chipotle, ancho, chili pepper
""")
FRIENDLY_TRIGGERS = _lines("""
garlic, onion, milk, cheese, cream, wheat, bread, bean, lentil, broccoli,
cauliflower, apple, pear
""")

# ---- fixed values: restrictions --------------------------------------------
STRICT_TYPES = ("allergy", "strict_sensitivity", "forbidden_ingredient", "diet_violation")
STRICT_TEXT = ("1", "true", "yes", "strict")
RESTRICTION_ALIASES = _table("""
dairy: milk, cream, yogurt, cheese, butter, whey, casein
egg: egg, albumen, meringue
gluten: wheat, barley, rye, spelt, semolina, bulgur, seitan
peanut: peanut, groundnut
soy: soy, soya, soybean, tofu, tempeh, edamame
tree nut: almond, brazil nut, cashew, hazelnut, macadamia, pecan, pistachio, walnut
nut: peanut, almond, brazil nut, cashew, hazelnut, macadamia, pecan, pistachio, walnut
shellfish: shrimp, prawn, crab, lobster, crayfish, mussel, clam, oyster, scallop
""")
MASKED_RESTRICTIONS = ("dairy", "milk", "cream")
MASK_PHRASES = _lines("""
almond milk, cashew milk, coconut cream, coconut milk, cream of tartar, hemp milk,
oat milk, plant milk, rice milk, soy milk
""")

# ---- fixed values: trigger groups --------------------------------------------
GROUP_PRIORS = {
    "fructans_gos": 0.55,
    "lactose": 0.50,
    "excess_fructose": 0.45,
    "polyols": 0.45,
    "gas_producing": 0.35,
    "fatty_spicy_processed": 0.35,
    "caffeine_alcohol_fizzy": 0.30,
    "fiber_sensitive": 0.25,
}
DEFAULT_GROUP_PRIOR = 0.25
TRIGGER_GROUPS = tuple(GROUP_PRIORS)
GROUP_ALIASES = _table("""
fructans_gos: garlic, garlic powder, onion, onion powder, shallot, leek, spring onion white, scallion white, wheat, wheat flour, plain flour, all purpose flour, bread, pasta, spaghetti, macaroni, penne, fettuccine, lasagna, couscous, wheat noodles, ramen noodles, rye, barley, spelt, semolina, bulgur, farro, inulin, chicory root, artichoke, asparagus, black beans, kidney beans, baked beans, pinto beans, navy beans, cannellini beans, lentils, chickpeas, garbanzo beans, hummus, split peas, soybeans, edamame, cashews, pistachios
lactose: cow milk, goat milk, evaporated milk, condensed milk, heavy cream, sour cream, whipped cream, ice cream, yogurt, greek yogurt, soft cheese, cream cheese, ricotta, cottage cheese, custard, kefir, milk chocolate, whey protein, buttermilk
excess_fructose: apple, pear, mango, watermelon, cherry, honey, agave, high fructose corn syrup, fruit juice, apple juice, orange juice, dried fruit, raisins, dates, figs, prunes, peach, nectarine, apricot, plum, persimmon, lychee
polyols: sorbitol, mannitol, xylitol, maltitol, erythritol, isomalt, sugar free gum, sugar free candy, mushroom, cauliflower, snow peas, sugar snap peas, avocado, sweet corn
gas_producing: broccoli, cabbage, brussels sprouts, kale, radish, turnip, sauerkraut, coleslaw, raw salad
fatty_spicy_processed: fried food, french fries, onion rings, fried chicken, bacon, sausage, salami, pepperoni, processed meat, hot dog, chili pepper, jalapeno, hot sauce, spicy food, curry, cream sauce, gravy, butter, margarine, mayonnaise, fast food, pizza, burger, chocolate, cocoa
caffeine_alcohol_fizzy: coffee, espresso, latte, cappuccino, black tea, energy drink, cola, soda, soft drink, fizzy drink, sparkling water, beer, wine, liquor, vodka, whiskey, rum, tequila, cocktail, alcohol
fiber_sensitive: bran, oat bran, high fiber cereal, granola, whole wheat bread, wholegrain bread, whole grain bread, brown rice, quinoa, chia seeds, flaxseed, almonds, walnuts, peanuts, popcorn
""")
FLOUR_GROUP = "fructans_gos"
FLOUR_MARKERS = _lines("""
almond flour, rice flour, coconut flour, corn flour, oat flour, chickpea flour,
gluten free flour, buckwheat flour, cassava flour, tapioca flour
""")
FLOUR_DROPPED = ("plain flour", "all purpose flour", "wheat flour", "wheat")
DAIRY_GROUP = "lactose"
DAIRY_MARKERS = _lines("""
almond milk, soy milk, oat milk, coconut milk, rice milk, cashew milk, plant milk,
lactose free, dairy free, non dairy, coconut cream, cream of tartar
""")
DAIRY_BARE = ("milk", "cream")
KEYWORD_PRIORS = {
    "garlic": 0.65, "onion": 0.65, "shallot": 0.60, "leek": 0.55, "wheat": 0.52,
    "bread": 0.45, "pasta": 0.45, "milk": 0.52, "cream": 0.50, "yogurt": 0.45,
    "cheese": 0.40, "apple": 0.42, "pear": 0.42, "mango": 0.40, "honey": 0.38,
    "mushroom": 0.42, "cauliflower": 0.38, "beans": 0.45, "lentils": 0.45,
    "chickpeas": 0.42, "broccoli": 0.32, "cabbage": 0.32, "fried": 0.28,
    "spicy": 0.30, "coffee": 0.25, "alcohol": 0.30,
}
KEYWORD_DEFAULT = 0.08

# ---- fixed values: sources of meal nutrition; macros in grams come from the second list only
NUTRITION_SOURCES = ("manual", "catalog_recipe", "gemini_estimate")
GRAM_SOURCES = ("manual", "gemini_estimate")

# ---- fixed values: risk attribution ------------------------------------------
WINDOW_HOURS = 48
DECAY_HOURS = 18.0
POSITIVE_SEVERITY = 0.20
PRIOR_POSITIVE = 0.75
PRIOR_TOTAL = 3.0
EVIDENCE_FULL = 6.0
CHECKIN_WINDOWS = ("hours_0_8", "hours_9_16", "hours_17_24")
CHECKIN_WEIGHTS = (1.0, 0.65, 0.35)
CHECKIN_OFFSETS = (-4.0, -12.5, -20.5)

# ---- fixed values: normalizing words -------------------------------------------
IRREGULAR_SINGULARS = {
    "leaves": "leaf", "loaves": "loaf", "potatoes": "potato", "tomatoes": "tomato",
}
UNINFLECTED = ("gas", "molasses")
CONTENT_STOP_WORDS = _lines("""
and, the, with, for, from, into, your, this, that, recipe, recipes, fresh, easy,
best, quick, simple, style, cup, cups, tbsp, tsp
""")

# ---- fixed values: symptom features ------------------------------------------------
LEGACY_FLAGS = _table("""
contains_garlic: garlic
contains_onion: onion, shallot, leek
contains_wheat: wheat, flour, bread, pasta
contains_lactose: milk, cream, yogurt, cheese, butter
contains_fructans: garlic, onion, wheat, bread, pasta, beans, lentils
contains_polyols: mushroom, cauliflower, avocado, sorbitol
""")
UNIT_FAMILIES = _table("""
grams: g, gram, grams, kg, kilogram, kilograms
ounces: oz, ounce, ounces, lb, pound, pounds
servings: serving, servings, portion, portions, piece, pieces
volume: ml, milliliter, milliliters, l, liter, liters, cup, cups, tbsp, tablespoon, tablespoons, tsp, teaspoon, teaspoons
""")
ITEM_BUCKETS = {
    "minutes": (15.0, 30.0, 60.0, 120.0),
    "steps": (5.0, 10.0, 20.0, 35.0),
    "ingredient_count": (5.0, 10.0, 15.0, 25.0),
}
NUTRITION_BUCKETS = {
    "calories": (150.0, 300.0, 500.0, 800.0),
    "fat": (5.0, 15.0, 30.0, 50.0),
    "sugar": (5.0, 15.0, 30.0, 60.0),
    "sodium": (5.0, 15.0, 30.0, 60.0),
    "protein": (5.0, 15.0, 30.0, 50.0),
    "saturated_fat": (3.0, 8.0, 15.0, 30.0),
    "carbs": (15.0, 30.0, 60.0, 100.0),
}

# ---- fixed values: cold-start questionnaire: groups and weight per question --------
QUESTIONS = {
    "lactose": (("lactose",), 1.0),
    "wheat_fructans": (("fructans_gos",), 0.9),
    "onion_garlic": (("fructans_gos",), 1.0),
    "legumes": (("fructans_gos", "gas_producing"), 0.85),
    "fructose": (("excess_fructose",), 1.0),
    "polyols": (("polyols",), 1.0),
    "gas_vegetables": (("gas_producing",), 0.85),
    "fat_spice_processed": (("fatty_spicy_processed",), 0.65),
    "drinks": (("caffeine_alcohol_fizzy",), 0.8),
    "fiber": (("fiber_sensitive",), 0.65),
}

# ---- fixed values: habit tree ---------------------------------------------------------
DEATH_DAYS = 7
ZONES = (("ufo", 300), ("space", 200), ("clouds", 100), ("canopy", 30), ("oasis", 7))
GROUND_ZONE = "ground"
MILESTONES = (7, 30, 100, 200, 300)

# ---- fixed values: insight cards ----------------------------------------------------------
STALE_DAYS = {"meal": 3, "feeling": 5, "analysis": 7, "cookbook": 14}

# ---- fixed values: image metadata ---------------------------------------------------------
NON_FOOD_TERMS = _lines("""
book, books, notebook, journal, magazine, library, paper, pen, pencil, desk, office,
laptop, keyboard, document
""")
NON_FOOD_URL_TERMS = NON_FOOD_TERMS + ("textbook", "reading", "school", "study")
FOOD_IMAGE_TERMS = _lines("""
food, meal, dish, recipe, plate, bowl, drink, smoothie, juice, fruit, vegetable, bread,
cake, salad, soup, pasta, rice, chicken, fish, dessert, breakfast, pancake, pancakes,
waffle, waffles, corn
""")
BLOCKED_SIGNATURES = _lines("""
photo-1495446815901-a7297e633e8d, photo-1497633762265-9d179a990aa6,
photo-1507842217343-583bb7270b66, photo-1512820790803-83ca734da794,
photo-1516979187457-637abb4f9353, photo-1524995997946-a1c2e315a42f,
photo-1528207776546-365bb710ee93, photo-1544716278-ca5e3f4abd8c
""")

# ---- fixed values: plans -------------------------------------------------------------------
PREMIUM_VALUES = ("premium", "pro", "paid")
TRIAL_DAYS = 30

# ---- fixed values: category rules; the general rules are a table parameter ----------------
SPECIFIC_CATEGORIES = _table("""
banana_bread: banana bread, banana loaf
chocolate_cake: chocolate cake, chocolate cupcake, chocolate torte, brownie cake
apple_pie: apple pie, apple tart, apple crisp, apple crumble
chicken_soup: chicken soup, chicken stew, chicken chili, chicken chowder
beef_stew: beef stew, beef chili, beef soup, pot roast, braised beef
shrimp_pasta: shrimp pasta, shrimp linguine, shrimp fettuccine, seafood pasta
tuna_salad: tuna salad, salmon salad, seafood salad
rice_bowl: rice bowl, rice and, burrito bowl, grain bowl, quinoa bowl, tofu bowl
breakfast_bowl: breakfast bowl, oat bowl, oatmeal bowl, smoothie bowl, yogurt bowl
roasted_vegetables: roasted vegetables, roast vegetables, roasted veggie, grilled vegetables
dips_spreads: hummus, guacamole, bean dip, cheese dip, spinach dip, pesto, spread
smoothie_bowl: smoothie bowl, acai bowl
""")
MEAL_TYPE_CATEGORIES = _table("""
meal_breakfast: breakfast, oats, oat, egg, pancake, waffle, toast, granola, cereal, yogurt
meal_baked: flour, yeast, baking powder, baking soda, dough, bake
meal_dessert: sugar, vanilla, cocoa, frosting, sweetened, dessert
meal_drink: drink, beverage, juice, tea, coffee, lemonade, smoothie
soup_stew_chili: broth, stock, bouillon, simmer, stew, soup, chili
meal_grain_bowl: rice, quinoa, barley, farro, couscous, grain, bowl
meal_main: chicken, beef, pork, salmon, fish, shrimp, tofu, steak
""")
FALLBACK_CATEGORY = "general_food"

# ---- fixed values: chat text ---------------------------------------------------------------
FOOD_TERMS = _lines("""
rice, chicken, beef, steak, pork, turkey, lamb, fish, salmon, tuna, cod, shrimp, prawn,
egg, eggs, tofu, tempeh, potato, sweet potato, carrot, cucumber, tomato, spinach,
lettuce, zucchini, eggplant, bell pepper, pumpkin, squash, green beans, peas, corn,
banana, orange, berries, strawberry, blueberry, grapes, kiwi, pineapple, lemon, lime,
oats, oatmeal, cereal, toast, sandwich, wrap, taco, burrito, quesadilla, sushi, poke,
falafel, shawarma, sabich, schnitzel, soup, stew, salad, omelet, omelette, pancake,
waffle, muffin, cake, donut, doughnut, cheese, halloumi, feta, mozzarella, parmesan,
olive, olive oil, sesame, tahini, peanut butter, jam, salsa, smoothie, protein shake,
tea, water
""")
CANCEL_PATTERN = (
    r"(?i)^(?:please\s+)?(?:cancel|stop|exit|quit|back|nevermind|never\s+mind|forget\s+it"
    r"|leave\s+it|nothing|skip|i\s+(?:do\s+not|don't)\s+want\s+to)"
    r"(?:\s+(?:this|that|logging|food\s+log|food\s+logging))?[.!]?$"
)
STOCK_REPLY_PATTERN = (
    r"(?i)^(?:hey+|hi+|hello|hiya|yo|sup|howdy|yes|yeah|yep|no|nope|ok|okay|sure|thanks"
    r"|thank\s+you|please|good|great|fine|cool|nice|maybe|idk|i\s+don'?t\s+know|help|test"
    r"|testing|lol|bye|goodbye)[.!]*$"
)
QUESTION_PATTERN = (
    r"(?i)^(?:who|what|where|when|why|how)\b|^(?:can|could|would|should|do|does|did|is|are"
    r"|am|will)\s+(?:you|i|we|this|that|it)\b"
)
ALLERGY_PATTERNS = (
    r"(?i)\b(?:i\s+am|i['’]?m|im)\s+(?:(?:severely|highly|very)\s+)?allergic\s+to\s+",
    r"(?i)\bi\s+have\s+(?:(?:a|an)\s+)?(?:(?:severe|serious)\s+)?allerg(?:y|ies)\s+to\s+",
)
HEDGE_PATTERN = (
    r"(?i)\b(?:if|maybe|may|might|possibly|probably|suspect|think|unsure|wonder)\b"
)
NON_INGREDIENT_PATTERN = (
    r"(?i)\b(?:avoid|because|can|could|do|does|don['’]?t|it|please|recipe|recommend"
    r"|remember|save|show|that|them|these|this|those|why|would)\b"
)
LABELED_LINE_PATTERN = (
    r"(?i)^\s*(title|recipe|cooklist|list|image|ingredients|steps|instructions|notes)\s*:"
)
CHAT_GREETING = "Hello! How can I help you today?"
CHAT_VISIBLE = 80
CONTEXT_CHARS = 7000

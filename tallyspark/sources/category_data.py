"""The built-in categories, their texts and terms, and the merchant directory."""

# Default categories and their icons.
DEFAULT_CATEGORIES = {
    "Groceries": "shopping_cart",
    "Fruits & Vegetables": "spa",
    "Restaurants": "restaurant",
    "Transport": "directions_bus",
    "Household": "home",
    "Medicine": "local_hospital",
    "Shopping": "shopping_bag",
    "Bills": "receipt_long",
    "Entertainment": "movie",
    "Personal Care": "face",
    "Other": "category",
}

# The text embedded for each category without examples.
DESCRIPTIONS = {
    "Groceries": "groceries, supermarket food, milk, rice, meat, chicken, pantry staples, packaged food, بقالة، سوبر ماركت، لبن، أرز، لحوم، فراخ، مواد غذائية",
    "Fruits & Vegetables": "fresh fruit, vegetables, produce, apples, bananas, tomatoes, potatoes, فواكه، خضروات، خضار، تفاح، موز، طماطم، بطاطس",
    "Restaurants": "restaurants, cafes, takeaway meals, fast food, coffee shops, dining, مطاعم، كافيهات، وجبات، أكل جاهز، قهوة",
    "Transport": "transport, taxi, ride hailing, metro, bus, train, fuel, parking, مواصلات، تاكسي، أوبر، كريم، مترو، أتوبيس، بنزين، ركن",
    "Household": "household supplies, cleaning products, detergent, dish soap, disinfectant, home maintenance, مستلزمات منزل، منظفات، مسحوق غسيل، صابون أطباق، مطهرات",
    "Medicine": "medicines, pharmacy products, vitamins, medical supplies, drugs, supplements, أدوية، صيدلية، فيتامينات، مستلزمات طبية، مكملات غذائية",
    "Shopping": "clothing, shoes, electronics, accessories, general retail shopping, online shopping, ملابس، أحذية، إلكترونيات، إكسسوارات، تسوق، مشتريات",
    "Bills": "utility bills, electricity, water, gas, internet, mobile plan, subscriptions due, فواتير، كهرباء، مياه، غاز، إنترنت، موبايل",
    "Entertainment": "movies, cinema, streaming, games, concerts, amusement, leisure activities, ترفيه، سينما، أفلام، ألعاب، حفلات، اشتراكات مشاهدة",
    "Personal Care": "personal care, shampoo, soap, skincare, cosmetics, grooming, barber, salon, عناية شخصية، شامبو، صابون، عناية بالبشرة، مستحضرات تجميل، حلاق",
    "Other": "miscellaneous items, uncategorized purchases, donations, fees, services, other expenses, مصاريف أخرى، متفرقات، رسوم، خدمات، تبرعات، غير مصنف",
    "Books": "books, novels, textbooks, reading, literature, educational books, technical books, كتب، روايات، مراجع، كتب دراسية، قراءة، أدب",
}

# Words that identify a category on their own.
LEXICAL_TERMS = {
    "Groceries": ["milk", "rice", "chicken", "cheese", "tuna", "لبن", "ارز", "أرز", "فراخ", "جبنة"],
    "Fruits & Vegetables": [
        "tomato", "tomatoes", "banana", "apple", "orange", "pomegranate", "plum", "guava", "fig", "grape", "grapes",
        "strawberry", "mango", "cucumber", "potato", "onion", "pepper", "zucchini", "carrot",
        "طماطم", "موز", "تفاح", "برتقال", "رمان", "برقوق", "جوافة", "جوافه", "تين", "عنب",
        "فراولة", "فراوله", "مانجو", "خيار", "بطاطس", "بصل", "فلفل", "كوسة", "كوسه", "جزر",
    ],
    "Restaurants": ["restaurant", "cafe", "pizza", "burger", "cappuccino", "latte", "kfc", "مطعم", "كافيه", "بيتزا", "برجر", "قهوة"],
    "Transport": ["uber", "careem", "metro", "taxi", "fuel", "gasoline", "parking", "أوبر", "كريم", "مترو", "تاكسي", "بنزين"],
    "Household": ["dettol", "detergent", "cleaner", "bleach", "persil", "clorox", "fairy", "منظف", "منظفات", "مطهر", "برسيل"],
    "Medicine": ["panadol", "folic", "vitamin", "medicine", "pharmacy", "capsule", "tablet", "بنادول", "دواء", "صيدلية", "فيتامين"],
    "Shopping": ["shirt", "shoes", "electronics", "clothing", "تيشيرت", "ملابس", "أحذية", "الكترونيات", "إلكترونيات"],
    "Bills": ["bill", "electricity", "internet", "utility", "فاتورة", "فواتير", "كهرباء", "انترنت", "إنترنت"],
    "Entertainment": ["cinema", "netflix", "movie", "game", "سينما", "فيلم", "العاب", "ألعاب"],
    "Personal Care": ["shampoo", "skincare", "razor", "gillette", "salon", "شامبو", "عناية", "حلاق"],
    "Books": ["book", "books", "novel", "textbook", "atomic", "رواية", "كتاب", "كتب"],
}

# The merchant directory, with the default category where there is one.
MERCHANT_DIRECTORY = [
    ("Carrefour", None),
    ("Hyper One", None),
    ("Spinneys", None),
    ("Metro Market", None),
    ("BIM", None),
    ("Kazyon", None),
    ("Seoudi", None),
    ("Gourmet Egypt", None),
    ("El Ezaby Pharmacy", "Medicine"),
    ("19011 Pharmacy", "Medicine"),
    ("Misr Pharmacies", "Medicine"),
    ("Talabat", "Restaurants"),
    ("McDonald's", "Restaurants"),
    ("KFC", "Restaurants"),
    ("Pizza Hut", "Restaurants"),
    ("Starbucks", "Restaurants"),
    ("Amazon Egypt", None),
    ("Noon", None),
    ("Jumia", None),
    ("LC Waikiki", "Shopping"),
    ("DeFacto", "Shopping"),
    ("H&M", "Shopping"),
    ("Uber", "Transport"),
    ("inDrive", "Transport"),
    ("DiDi", "Transport"),
    ("Shell", None),
    ("TotalEnergies", None),
    ("ChillOut", None),
    ("Vodafone", "Bills"),
    ("Orange", "Bills"),
    ("Etisalat by e&", "Bills"),
    ("WE", "Bills"),
]

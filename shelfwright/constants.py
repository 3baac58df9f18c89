"""Results depend on these exact words, numbers and orders."""

# Query parameters dropped by URL normalisation.
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "fbclid", "gclid", "_ga", "_gac", "_gad",
    "mc_cid", "mc_eid", "ref", "source", "campaign", "msclkid", "gclsrc",
]

# Host name to site name.
HOST_SITES = {
    "motoheaven.com.au": "motoheaven",
    "www.motoheaven.com.au": "motoheaven",
    "mcas.com.au": "mcas",
    "www.mcas.com.au": "mcas",
    "bikebiz.com.au": "bikebiz",
    "www.bikebiz.com.au": "bikebiz",
    "amx.com.au": "amx",
    "www.amx.com.au": "amx",
}

# Path markers of product and of collection URLs, and category path words in order.
PRODUCT_MARKERS = ["/products/", "/product/", "/item/", "/p/", "/gear/"]
COLLECTION_MARKERS = [
    "/collections/", "/collection/", "/category/", "/categories/", "/shop/", "/browse/",
]
CATEGORY_PATHS = ["collections", "category", "shop", "browse"]

# Candidate site-map paths.
SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemaps.xml", "/robots.txt"]

# Brand dictionary; the first entry that matches a name wins.
BRANDS = [
    "Dainese", "Alpinestars", "AGV", "Shoei", "Arai", "Bell", "Shark", "HJC", "Scorpion", "TCX",
    "Sidi", "Forma", "Gaerne", "Rev'it", "Revit", "Oxford", "Rukka", "Klim", "RST", "Held",
    "Spidi", "Five", "Knox", "Richa", "Bull-it", "Bullitt", "Icon", "Joe Rocket", "Alpinestars",
    "Thor", "Fox", "Oneal", "O'Neal", "Leatt", "Troy Lee", "Acerbis", "UFO", "Polisport",
    "Racetech", "Race Tech", "Pro Grip", "ProGrip", "Michelin", "Pirelli", "Bridgestone",
    "Dunlop", "Continental", "Metzeler", "Avon", "Shinko", "Kenda", "Maxxis", "IRC", "Heidenau",
]

# Words in a title or URL that mean the fetch was blocked, in order.
BLOCK_WORDS = [
    "access denied", "blocked", "rate limit", "too many requests", "captcha", "bot detection",
    "suspicious activity", "403", "429", "cloudflare",
]
CHALLENGE_WORDS = ["challenge", "verify"]

# Words that mark a text as being about a product.
PRODUCT_KEYWORDS = [
    "add to cart", "buy now", "purchase", "price", "in stock", "out of stock", "product",
    "brand", "model", "sku",
]

# Certification patterns in order, vehicle types and makes.
CERTIFICATION_PATTERNS = [
    r"\b(CE)\b", r"\b(DOT)\b", r"\b(ECE)\b", r"\b(SNELL)\b", r"\b(ADR)\b",
    r"\b(AS/NZS\s*\d+(?:\.\d+)?)\b",
]
VEHICLE_TYPES = ["motorcycle", "bike", "scooter", "atv", "quad"]
VEHICLE_MAKES = [
    "yamaha", "honda", "kawasaki", "suzuki", "ducati", "bmw", "harley", "triumph", "ktm",
]

# Size button texts; image URL words to keep and to drop.
SIZE_TEXTS = ["XS", "S", "M", "L", "XL", "XXL"]
IMAGE_KEEP_WORDS = ["agv", "helmet", "motorcycle", "product", "cdn.shop"]
IMAGE_DROP_WORDS = ["logo", "icon", "payment", "social", "trustpilot"]

# Accepted image types, size limit, extensions and path words.
IMAGE_TYPES = ["image/jpeg", "image/jpg", "image/png", "image/webp", "image/svg+xml"]
IMAGE_MAX_BYTES = 10 * 1024 * 1024
MIME_EXTENSIONS = {
    "image/jpeg": ".jpg",
    "image/jpg": ".jpg",
    "image/png": ".png",
    "image/webp": ".webp",
    "image/svg+xml": ".svg",
    "image/gif": ".gif",
}
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp", ".svg", ".gif"]
IMAGE_PATH_WORDS = ["image", "photo", "picture", "img"]

# Log level ranks.
LEVEL_RANKS = {"debug": 0, "info": 1, "warn": 2, "error": 3}

# Enumerations of the product model.
STOCK_STATUSES = ["in_stock", "out_of_stock", "backorder", "preorder"]
VARIANT_TYPES = ["size", "color", "style", "material"]
ADAPTER_TYPES = ["shopify", "mcas", "generic"]
CURRENCY = "AUD"

# Columns of the flat export, in order.
CSV_COLUMNS = [
    "id", "name", "brand", "sku", "category", "subcategory", "regular_price", "sale_price",
    "currency", "discount_percentage", "in_stock", "stock_status", "quantity",
    "short_description", "full_description", "specifications", "certifications",
    "compliance_adr", "compliance_standards", "vehicle_types", "makes", "models", "site",
    "source_url", "scraped_at", "quality_score",
]
CSV_VARIANT_COLUMNS = [
    "variant_id", "variant_name", "variant_type", "variant_value", "variant_sku",
    "variant_regular_price", "variant_sale_price", "variant_in_stock", "variant_stock_status",
    "variant_images",
]

# Raw field names that carry each product attribute, in order of preference.
RAW_FIELDS = [
    "name", "title", "product_title", "product_name",
    "price", "cost", "amount", "regular_price", "sale_price",
    "description", "desc", "product_description", "summary",
    "brand", "manufacturer", "vendor",
    "category", "product_type", "collection",
    "images", "photos", "image_urls",
    "variants", "options",
    "sku", "product_id", "handle",
    "availability", "in_stock", "stock_status",
    "url", "source_url", "_source_url",
]
RAW_VARIANT_FIELDS = [
    "id", "title", "name", "price", "sale_price", "sku", "barcode", "inventory_quantity",
    "available", "weight", "size", "color", "option1", "option2", "option3",
]

"""Values that results depend on. They are fixed: a change here changes every answer."""

# Value of `status` that marks a sale as approved.
APPROVED = "APPROVED"

# Product given to sales that carry none (old sales, when only this product existed).
DEFAULT_PRODUCT = "mpos"

# Province given to accounts that carry none.
DEFAULT_PROVINCE = "Ciudad Autónoma de Buenos Aires"

# Products by sales channel; every other product is OTHER.
IN_PERSON_PRODUCTS = ["mpos", "standalone", "qr", "SDK", "smartpos", "softpos", "caja_pos"]
ONLINE_PRODUCTS = [
    "payment_link", "api_checkout", "plugins", "online_catalog", "api_payments", "PCT", "tienda_geo",
]
IN_PERSON, ONLINE, OTHER = "presencial", "online", "otro"

# Names of the inactivity definitions.
DEFINITION_X3 = "Frecuencia × 3"
DEFINITION_X2 = "Frecuencia × 2"
DEFINITION_60D = "Inactividad > 60 días"

# Outcomes of a definition: flagged and gone, flagged but back, not flagged and back, not flagged but gone.
HIT_LEFT, MISS_BACK = "Acertó (fugado)", "Falló (volvió)"
HIT_ACTIVE, MISS_LEFT = "Acertó (activo)", "Falló (se fue)"

# Text form of the label.
STAYED, LEFT = "No", "Si"

# Value for measures that need two events of a client that has one.
SENTINEL = -1.0

# Display factor of logistic coefficients next to tree importances.
COEFFICIENT_DISPLAY_FACTOR = 1000

# Effect classes of a coefficient.
RISK, PROTECTIVE = "Factor de Riesgo", "Factor Protector"
HIGH, MEDIUM, LOW = "Alto", "Medio", "Bajo"

# Names of the evaluated model configurations.
MODEL_TREE = "Árbol de decisión (CV externa)"
MODEL_FOREST_HALF = "Random Forest (Grid Search + CV) - threshold=0.5"
MODEL_FOREST_BEST = "Random Forest (Grid Search + CV) - threshold=óptimo"
MODEL_LOGISTIC_HALF = "Regresión Logística (LASSO) - threshold=0.5"
MODEL_LOGISTIC_BEST = "Regresión Logística (LASSO) - threshold=óptimo"
FAMILY_FOREST, FAMILY_TREE, FAMILY_LOGISTIC = "Random Forest", "Árbol de Decisión", "Regresión Logística"

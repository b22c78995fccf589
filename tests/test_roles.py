from caisse.roles import ROLE_CANDIDATES, infer_column, normalize_columns, normalize_name, role_map


def test_normalize_name_accents_and_runs():
    assert normalize_name("  Coût total ") == "co_t_total"
    assert normalize_name("Date Vente") == "date_vente"
    assert normalize_name("Chiffre d'affaires (€)") == "chiffre_d_affaires"
    assert normalize_name("Quantité") == "quantit"


def test_normalize_columns_empty_and_duplicates():
    assert normalize_columns(["A", "a", "", "a "]) == ["a", "a_2", "col_2", "a_3"]


def test_short_candidates_match_only_exactly():
    assert infer_column(["candidate"], ROLE_CANDIDATES["date"]) == "candidate"  # 'date' inside 'candidate'
    assert infer_column(["cat"], ROLE_CANDIDATES["revenue"]) is None  # 'ca' needs an exact key
    assert infer_column(["ca"], ROLE_CANDIDATES["revenue"]) == "ca"
    assert infer_column(["sku_code"], ROLE_CANDIDATES["product"]) is None
    assert infer_column(["dt"], ROLE_CANDIDATES["date"]) == "dt"


def test_role_traps():
    assert infer_column(["cout_total"], ROLE_CANDIDATES["revenue"]) == "cout_total"  # through 'total'
    assert infer_column(["sales_rep", "montant_ttc"], ROLE_CANDIDATES["revenue"]) == "sales_rep"
    assert infer_column(["capacity"], ROLE_CANDIDATES["city"]) == "capacity"
    roles = role_map(["client", "montant"])
    assert roles["client"] == "client" and roles["revenue"] == "montant"


def test_key_collision_last_column_wins_and_first_for_substring():
    assert infer_column(["Client", "client"], ["client"]) == "client"
    assert infer_column(["nom_client_a", "nom_client_b"], ["client"]) == "nom_client_a"


def test_one_column_two_roles():
    roles = role_map(["vente_client_total"])
    assert roles["client"] == "vente_client_total"
    assert roles["revenue"] == "vente_client_total"

"""Tables of the listing domain, as Spark DDL. Prices are whole numbers of 10,000 yen, times wall clock without zone."""

TABLES = {
    "buildings": "id long, normalized_name string, canonical_name string, reading string, address string, normalized_address string, total_floors int, basement_floors int, total_units int, built_year int, built_month int, construction_type string, land_rights string, station_info string, is_valid_name boolean, latitude double, longitude double, created_at timestamp_ntz, updated_at timestamp_ntz",
    "master_properties": "id long, building_id long, room_number string, floor_number int, area double, balcony_area double, layout string, direction string, management_fee int, repair_fund int, parking_info string, display_building_name string, current_price int, sold_at timestamp_ntz, final_price int, earliest_listing_date timestamp_ntz, latest_price_change_at timestamp_ntz, created_at timestamp_ntz",
    "property_listings": "id long, master_property_id long, source_site string, site_property_id string, url string, title string, current_price int, management_fee int, repair_fund int, agency_name string, remarks string, listing_building_name string, listing_floor_number int, listing_area double, listing_layout string, listing_direction string, listing_total_floors int, listing_total_units int, listing_building_structure string, listing_built_year int, listing_built_month int, listing_balcony_area double, listing_address string, listing_basement_floors int, listing_land_rights string, listing_parking_info string, listing_station_info string, is_active boolean, first_seen_at timestamp_ntz, last_scraped_at timestamp_ntz, published_at timestamp_ntz, first_published_at timestamp_ntz, price_updated_at timestamp_ntz, last_confirmed_at timestamp_ntz, delisted_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz",
    "listing_price_history": "id long, property_listing_id long, price int, management_fee int, repair_fund int, recorded_at timestamp_ntz",
    "building_listing_names": "id long, building_id long, normalized_name string, canonical_name string, source_sites string, occurrence_count int, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz",
    "building_merge_exclusions": "building1_id long, building2_id long",
    "property_merge_exclusions": "property1_id long, property2_id long",
    "property_price_changes": "master_property_id long, change_date date, new_price int, old_price int, price_diff int, price_diff_rate double, new_price_votes long, old_price_votes long",
    "property_price_change_queue": "master_property_id long, reason string, priority int, status string, created_at timestamp_ntz",
    "transaction_prices": "id long, transaction_id string, property_type string, district_code string, district_name string, area_name string, transaction_price int, price_per_sqm int, transaction_period string, transaction_year int, transaction_quarter int, floor_area double, floor_number string, layout string, built_year int, building_structure string, remarks string, created_at timestamp_ntz",
    "property_bookmarks": "user_id long, master_property_id long, created_at timestamp_ntz",
    "ambiguous_property_matches": "building_id long, candidate_property_ids array<long>, confidence_score double, is_reviewed boolean, created_at timestamp_ntz",
}

"""Source trees: listing, filters, ignore rules, language front-ends."""

"""Sentences of the results."""

# Texts that are part of the output contract.
RANK_PLACE = "%s ranks #%s"
RANK_REASONS = "%s for this traveler on %s, weighted by what matters most to them."
RANK_ALL_ROUND = "%s as a strong all-round match."
QUOTED = '%s Guests note: "%s"'
SPLIT_CAVEAT = "Reviewers are split on %s."
SEASON_CAVEAT = "%s varies by season — strongest in %s, weakest in %s (%s confidence)."
TREND_CAVEAT = "%s has been %s over time (%s confidence)."
OVERALL_NAME = "Overall rating"
VERIFIED_SPLIT = "Verified reviewers are %s (%s vs %s unverified)."
VERIFIED_LEANS = ("more positive", "more negative")
SEGMENT_SPLIT = "%s travelers %s (%s vs %s for others)."
SEGMENT_LEANS = ("rate it higher", "rate it lower")
PROFILE_SUMMARY = "%s traveler (%s budget) prioritizing %s."
NO_DRIVER = "Mixed views, no clear driver."

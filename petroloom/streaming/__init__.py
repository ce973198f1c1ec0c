"""Keyframe selection over unbounded streams."""

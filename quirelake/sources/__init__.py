"""quirelake.sources"""
